"""A store of seasons that follows a folder of extract files: only changed seasons are written, all published at once.

Layout under the store's folder::

    seasons/generation=<n>/season=<year>/…    the rows of the seasons written by run n
    manifests/<n>/…                           the files every season was made of, and the generation that holds it

A run writes its seasons first and its manifest last; the manifest counts once the writer's ``_SUCCESS`` mark is in
place. Until then readers find the generation before, so a run that fails or loses its driver changes nothing
they see. Nothing is renamed, which object stores could not do at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitlab.sources import ingest

MANIFEST = "season int, source_file string, length long, modified timestamp, checksum string, generation int"
MARK = "_SUCCESS"


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str, prefix: str = "") -> list[int]:
    """Numbers of the folders below ``path``, ascending; none if it is not there."""
    place, files = _files(spark, path)
    if not files.exists(place):
        return []
    names = [status.getPath().getName() for status in files.listStatus(place)]
    return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit())


def generations(spark: SparkSession, path: str) -> list[int]:
    """Published generations, ascending."""

    def published(n: int) -> bool:
        mark, files = _files(spark, f"{path}/manifests/{n}/{MARK}")
        return files.exists(mark)

    return [n for n in _numbers(spark, f"{path}/manifests") if published(n)]


def manifest(spark: SparkSession, path: str, generation: int | None = None) -> DataFrame:
    """The files of every season in a generation, by default the newest; no rows if nothing is published."""
    if generation is None:
        known = generations(spark, path)
        if not known:
            return spark.createDataFrame([], MANIFEST)
        generation = known[-1]
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifests/{generation}")


def _listed(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Extract files below a folder; their bytes are read only where ``content`` is used."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    season = F.regexp_extract(name, ingest.SEASON_PATTERN, 1).try_cast("int")
    return found.select(
        season.alias("season"), name.alias("source_file"), "length", F.col("modificationTime").alias("modified"), "path", "content"
    )


def _current(spark: SparkSession, folder: str, pattern: str, old: DataFrame, verify: bool) -> list:
    """One row per extract file, with its checksum: the stored one if length and time are as they were.

    Files are held in the driver, as Spark holds them for any scan; their bytes are read by the tasks, and only
    those of files that look different, or of all with ``verify``.
    """
    listed = _listed(spark, folder, pattern)
    rows = listed.drop("content").collect()
    names = [row["source_file"] for row in rows]
    if len(set(names)) < len(names):
        raise ValueError(f"two files of one name: {sorted({n for n in names if names.count(n) > 1})}")
    if nameless := sorted(row["source_file"] for row in rows if row["season"] is None):
        raise ValueError(f"no season in the file names {nameless}")
    known = {} if verify else {(r["source_file"], r["length"], r["modified"]): r["checksum"] for r in old.collect()}
    sums = {r["source_file"]: known.get((r["source_file"], r["length"], r["modified"])) for r in rows}
    read = [row["path"] for row in rows if sums[row["source_file"]] is None]
    if read:
        content = _listed(spark, read, pattern).select("source_file", F.sha2("content", 256).alias("checksum"))
        sums.update({r["source_file"]: r["checksum"] for r in content.collect()})
    return [{**row.asDict(), "checksum": sums[row["source_file"]]} for row in rows]


def refresh(
    spark: SparkSession,
    folder: str,
    path: str,
    scan: Callable[..., DataFrame] = ingest.scan_plays,
    pattern: str = ingest.SEASON_FILES + ".csv",
    verify: bool = False,
    **options,
) -> list[int]:
    """Bring the store up to the extract files below ``folder``; returns the seasons written.

    A season is written anew when a file of it is new, gone, or has another length or checksum; ``scan`` gets its
    files only, with ``options``. A file with the length and time the manifest knows is not read unless ``verify``
    is set. A season none of whose files are left stays as it is. When nothing changed, nothing is written. Two runs
    at once cannot both publish: the second finds its generation taken and fails.
    """
    old = manifest(spark, path)
    before: dict[int, list] = {}
    for row in old.collect():
        before.setdefault(row["season"], []).append(row.asDict())
    now: dict[int, list] = {}
    for row in _current(spark, folder, pattern, old, verify):
        now.setdefault(row["season"], []).append(row)

    def content(rows: list) -> set:
        return {(r["source_file"], r["length"], r["checksum"]) for r in rows}

    changed = sorted(s for s, rows in now.items() if content(rows) != content(before.get(s, [])))
    if not changed:
        return []
    taken = [*_numbers(spark, f"{path}/manifests"), *_numbers(spark, f"{path}/seasons", "generation=")]
    generation = 1 + max(taken, default=0)
    table = scan(spark, [row["path"] for s in changed for row in now[s]], pattern=pattern, **options)
    table.write.mode("error").partitionBy("season").parquet(f"{path}/seasons/generation={generation}")
    columns = [part.split()[0] for part in MANIFEST.split(", ")]
    entries = [
        tuple({**row, "generation": generation if s in changed else before[s][0]["generation"]}[c] for c in columns)
        for s in sorted({*before, *now})
        for row in (now[s] if s in changed else before[s])
    ]
    _publish(spark.createDataFrame(entries, MANIFEST), f"{path}/manifests/{generation}")
    return changed


def _publish(entries: DataFrame, place: str) -> None:
    entries.coalesce(1).write.mode("error").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(place)


def read_store(
    spark: SparkSession, path: str, first: int | None = None, last: int | None = None, generation: int | None = None
) -> DataFrame:
    """The rows of the newest generation, or of an older one, in a range of seasons.

    Only the folders of those seasons are listed. A season whose files hold no rows has no folder.
    """
    held = manifest(spark, path, generation).select("season", F.col("generation").alias("at")).distinct()
    places = []
    for row in held.orderBy("season").collect():
        if (first is None or row["season"] >= first) and (last is None or row["season"] <= last):
            places.append(f"{path}/seasons/generation={row['at']}/season={row['season']}")
    present = []
    for place in places:
        folder, files = _files(spark, place)
        if files.exists(folder):
            present.append(place)
    if not present:
        raise ValueError(f"no season from {first} to {last} in {path}")
    return spark.read.option("basePath", f"{path}/seasons").parquet(*present).drop("generation")


def prune(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Delete what the newest ``keep`` generations do not need; returns the generations whose manifest went.

    Manifests go before rows, so that a run that is cut off leaves no manifest without its rows. Folders of
    failed runs go too; do not call it while another run writes.
    """
    if keep < 1:
        raise ValueError("keep at least one generation")
    known = generations(spark, path)
    kept = known[-keep:]
    needed = {(r["season"], r["generation"]) for n in kept for r in manifest(spark, path, n).select("season", "generation").collect()}
    gone = [n for n in _numbers(spark, f"{path}/manifests") if n not in kept]
    doomed = [f"{path}/manifests/{n}" for n in gone]
    for n in _numbers(spark, f"{path}/seasons", "generation="):
        base = f"{path}/seasons/generation={n}"
        here = [s for s in _numbers(spark, base, "season=") if (s, n) in needed]
        if not here:
            doomed.append(base)
        else:
            doomed += [f"{base}/season={s}" for s in _numbers(spark, base, "season=") if s not in here]
    for place in doomed:
        folder, files = _files(spark, place)
        files.delete(folder, True)
    return [n for n in gone if n in known]
