"""Product archives: their tables of contents and labels, and safe extraction."""

from __future__ import annotations

import io
import json
import stat
import uuid
from collections.abc import Iterator
from itertools import batched
from zipfile import ZIP_DEFLATED, BadZipFile, ZipFile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiepoint.functions.classify import is_safe_member, stem
from tiepoint.functions.labels import instant, values
from tiepoint.functions.session import materialise
from tiepoint.sources.images import decode, gray_of
from tiepoint.sources.store import place

#: Fixed value: how browse images are named; view, time stamp and variant.
BROWSE = r"(?i)(?:^|/)ch2_tmc_n[cr]([fna])_(\d{8}T\d+)_b_brw_([^/.]+)\.png$"
#: Fixed value: how geolocation grids are named; level, view, time stamp and resolution.
GRID = r"(?i)(?:^|/)ch2_tmc_n([cr])([fna])_(\d{8}T\d+)_g_grd_([^/.]+)\.csv$"
#: What is read of a product's label.
LABEL_VALUES = ("start_date_time", "stop_date_time", "logical_identifier", "records", "file_name")
MOST_BYTES, MOST_MEMBERS = 20 << 30, 100_000
#: Bytes of a member that a task holds while it extracts.
PIECE = 8 << 20
#: The files of a footprint.
FOOTPRINT = (".shp", ".shx", ".dbf", ".prj", ".cpg")


def _opened(path: str):
    """A random-access file of the store that ``path`` names; only what is asked for is read."""
    if path.startswith("file:"):
        return open("/" + path[5:].lstrip("/"), "rb")
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def members(spark: SparkSession, path: str, texts: str = r"(?i)\.xml$") -> DataFrame:
    """``archive, member, size, encrypted, mode, text, problem``: files of all ZIP archives of a folder or glob.

    An archive of any size is opened where it lies: its directory is read, and the
    members that match ``texts``. A broken archive is one row with a problem.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path).select("path")
    types = [pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.string(), pa.string()]
    names = ["archive", "member", "size", "encrypted", "mode", "text", "problem"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        wanted = re.compile(texts)

        def rows_of(name: str) -> Iterator[tuple]:
            try:
                with _opened(name) as f, ZipFile(f) as z:
                    for e in z.infolist():
                        if not e.is_dir():
                            locked = bool(e.flag_bits & 1)
                            text = z.read(e).decode("utf-8", "replace") if wanted.search(e.filename) and not locked else None
                            yield name, e.filename, e.file_size, locked, e.external_attr >> 16, text, None
            except BadZipFile as e:
                yield name, None, None, None, None, None, str(e)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                for rows in batched(rows_of(name), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return files.mapInArrow(run, "archive string, member string, size long, encrypted boolean, mode int, text string, problem string")


def zipped(found: DataFrame) -> DataFrame:
    """``product_id, band, content``: an archive of the rows ``archive, member, content``, as ``write_files`` takes it; one is as large as a task can hold."""

    def pack(table: pa.Table) -> pa.Table:
        out = io.BytesIO()
        with ZipFile(out, "w", ZIP_DEFLATED) as z:
            for name, content in zip(table.column("member").to_pylist(), table.column("content").to_pylist(), strict=True):
                z.writestr(name, content)
        return pa.table({"product_id": table.column("archive").slice(0, 1), "band": pa.array([0], pa.int32()), "content": pa.array([out.getvalue()], pa.binary())})

    return found.select("archive", "member", "content").groupBy("archive").applyInArrow(pack, "product_id string, band int, content binary")


def member_planes(wanted: DataFrame) -> DataFrame:
    """Pixels of images inside archives: ``pair_id, band, y, x, v, valid`` and ``problem``, for rows ``pair_id, archive, member``.

    Colours become gray by the usual weights. An image that cannot be read is one row
    with a problem and no pixels. A row's image is decoded by the task that has the row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                try:
                    with _opened(r["archive"]) as f, ZipFile(f) as z:
                        image = gray_of(decode(r["member"], z.read(r["member"])))
                except Exception as e:  # any broken image is a row, not a failed job
                    yield pa.RecordBatch.from_arrays([pa.array([r["pair_id"]]), *(pa.array([None], t) for t in (pa.int32(), pa.int32(), pa.float64())), pa.array([f"{r['member']}: {e}"])], ["pair_id", "y", "x", "v", "problem"])
                    continue
                for top in range(0, image.shape[0], 256):
                    part = image[top : top + 256]
                    y, x = np.indices(part.shape, np.int32)
                    n = part.size
                    yield pa.RecordBatch.from_arrays([pa.array([r["pair_id"]] * n), pa.array(y.ravel() + np.int32(top)), pa.array(x.ravel()), pa.array(part.ravel().astype(float)), pa.nulls(n, pa.string())], ["pair_id", "y", "x", "v", "problem"])

    found = wanted.select("pair_id", "archive", "member").repartition("pair_id").mapInArrow(run, "pair_id string, y int, x int, v double, problem string")
    return found.select("pair_id", F.lit(0).alias("band"), "y", "x", "v", F.lit(True).alias("valid"), "problem")


def _labelled(found: DataFrame, pattern: str) -> DataFrame:
    """Members that match, with the label of the same stem in the same archive and its start; others are left out."""
    images = found.where(F.col("member").rlike(pattern)).select("archive", "member", stem(F.col("member")).alias("stem"))
    labels = found.where(F.lower("member").endswith(".xml")).select("archive", stem(F.col("member")).alias("stem"), F.col("member").alias("label"), F.col("text").alias("xml"))
    both = images.join(labels, ["archive", "stem"]).withColumn("label_of", values(F.col("xml"), LABEL_VALUES))
    both = both.withColumn("acquisition_start", F.col("label_of.start_date_time"))
    return both.where("acquisition_start is not null").withColumn("start", instant(F.col("acquisition_start")))


def browse_products(found: DataFrame, data_level: str) -> DataFrame:
    """Browse images with readable labels, as products to be paired."""
    part = lambda i: F.regexp_extract("member", BROWSE, i)
    return _labelled(found, BROWSE).select(
        "archive", "member", F.lower(part(1)).alias("sensor_view"), "acquisition_start", F.col("label_of.stop_date_time").alias("acquisition_stop"), F.col("label_of.logical_identifier").alias("product_id"),
        part(3).alias("variant"), F.lit(data_level).alias("data_level"), F.year("start").alias("year"), "start",
    )


def geolocation_grids(found: DataFrame) -> DataFrame:
    """Geolocation grids with their declared number of records."""
    part = lambda i: F.regexp_extract("member", GRID, i)
    return _labelled(found, GRID).select(
        F.col("member").alias("grid_id"), "archive", "label", F.lower(part(2)).alias("view"), part(1).alias("calibration"), part(4).alias("resolution"), F.col("label_of.logical_identifier").alias("product_id"),
        F.col("label_of.records").try_cast("long").alias("records"), F.col("label_of.file_name").alias("file_name"), "start",
    )


def with_sidecars(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Images with the label of the same path without suffix, where there is one."""
    a = images.withColumn("stem", stem(F.col("path")))
    b = labels.select(stem(F.col("path")).alias("stem"), F.col("xml"))
    return a.join(b, "stem", "left").drop("stem")


def _kept_out(member: Column, mode: Column, encrypted: Column) -> Column:
    """Why a member must not be extracted; null if it may be."""
    rules = [(~is_safe_member(member), "unsafe path"), (mode.bitwiseAND(0o170000) == stat.S_IFLNK, "symbolic link"), (encrypted, "encrypted")]
    return F.coalesce(*(F.when(rule, why) for rule, why in rules))


def unsafe(found: DataFrame) -> DataFrame:
    """Members that must not be extracted, and why."""
    return found.withColumn("why", _kept_out(F.col("member"), F.col("mode"), F.col("encrypted"))).where("why is not null")


def components(found: DataFrame, suffixes: tuple[str, ...] = FOOTPRINT) -> DataFrame:
    """``archive, member, name, content`` of the members with one of the suffixes; unsafe ones are left out.

    ``name`` is the archive's stem and the member's file name, as a sink takes it.
    """
    wanted = found.where(F.lower(F.concat(F.lit("."), F.substring_index("member", ".", -1))).isin(list(suffixes)) & _kept_out(F.col("member"), F.col("mode"), F.col("encrypted")).isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, member in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with _opened(name) as f, ZipFile(f) as z:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([member]), pa.array([z.read(member)], pa.binary())], ["archive", "member", "content"])

    read = wanted.select("archive", "member").repartition("archive", "member").mapInArrow(run, "archive string, member string, content binary")
    file = lambda c: F.substring_index(c, "/", -1)
    return read.select("archive", "member", F.concat_ws("_", F.regexp_replace(file(F.col("archive")), r"(?i)\.zip$", ""), file(F.col("member"))).alias("name"), "content")


def stage(spark: SparkSession, archive: str, destination: str, most_bytes: int = MOST_BYTES, most_members: int = MOST_MEMBERS) -> str:
    """Extracts an archive beside its destination and renames it into place: whole or not at all, never over something.

    The table of contents is judged first, by the same rules as ``unsafe``. Members are
    then extracted by many tasks, in pieces and into a folder of drafts, which is checked
    against the table of contents and published by one renaming, or removed. A
    ``manifest.json`` with the archive, its members and sizes stands in the result.
    """
    from pyarrow import fs

    found = materialise(members(spark, archive, r"(?!)"))
    if refused := unsafe(found).select("member", "why").first():
        raise ValueError(f"{refused['why']}: {refused['member']!r}")
    total = found.agg(F.count("member").alias("members"), F.count_distinct("member").alias("names"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.max("problem").alias("problem")).first()
    if total["problem"]:
        raise BadZipFile(total["problem"])
    if total["members"] > most_members or total["bytes"] > most_bytes:
        raise ValueError("the archive exceeds a limit")
    if total["names"] < total["members"]:
        raise ValueError("two members have one name")
    system, target = place(destination)
    if system.get_file_info(target).type != fs.FileType.NotFound:
        raise FileExistsError(destination)
    drafts = f"{destination.rstrip('/')}.drafts-{uuid.uuid4().hex}"

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = place(drafts)
        for batch in batches:
            sizes = []
            for name, member in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part, whole = f"{base}/parts/{uuid.uuid4().hex}", f"{base}/content/{member}"
                store.create_dir(f"{base}/parts", recursive=True)
                with _opened(name) as f, ZipFile(f) as z, z.open(member) as source, store.open_output_stream(part) as out:
                    while piece := source.read(PIECE):
                        out.write(piece)
                store.create_dir(whole.rsplit("/", 1)[0], recursive=True)
                store.move(part, whole)  # a task that is tried again does it again
                sizes.append(store.get_file_info(whole).size)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(sizes, pa.int64())], ["member", "size"])

    base = place(drafts)[1]
    try:
        listing = materialise(found.where("member is not null and member not like '%/'").select("archive", "member", "size"))
        wrong = listing.select("archive", "member").repartition("member").mapInArrow(extract, "member string, size long").exceptAll(listing.select("member", "size")).first()
        if wrong:
            raise BadZipFile(f"{wrong['member']} has {wrong['size']} bytes, which its archive does not say")
        system.create_dir(f"{base}/content", recursive=True)
        rows = [{"member": r["member"], "bytes": r["size"]} for r in listing.select("member", "size").orderBy("member").toLocalIterator()]  # MOST_MEMBERS at most
        with system.open_output_stream(f"{base}/content/manifest.json") as out:
            out.write(json.dumps({"archive": archive.rstrip("/").rsplit("/", 1)[-1], "members": rows}, indent=1).encode())
        system.create_dir(target.rsplit("/", 1)[0], recursive=True)
        system.move(f"{base}/content", target)
    finally:
        if system.get_file_info(base).type == fs.FileType.Directory:
            system.delete_dir(base)
    return destination
