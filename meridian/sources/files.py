"""Readers and writers of delimited, nested, markup and map files; schemas are always given."""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from pathlib import PurePosixPath
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridian.operators.records import upsert
from meridian.runtime import get_text, put_text

#: Members of archives are opened to this depth, size and ratio of expansion at most.
MAX_DEPTH, MAX_BYTES, MAX_RATIO, MAX_TOTAL_BYTES = 2, 64 * 1024 * 1024, 200, 256 * 1024 * 1024


def _there(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """A delimited file with a header, a byte-order mark allowed; an absent file is an empty table."""
    if not _there(spark, path):
        return spark.createDataFrame([], schema)
    strings = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", sep).option("enforceSchema", True).schema(strings).csv(path)
    return raw.select(*(F.nullif(F.col(f.name), F.lit("")).try_cast(f.dataType).alias(f.name) for f in schema))


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON document or array; an absent file is an empty table."""
    return spark.read.option("multiLine", True).schema(schema).json(path) if _there(spark, path) else spark.createDataFrame([], schema)


def write_csv(df: DataFrame, path: str, fields: list[str] | None = None) -> None:
    """Delimited files with a header and fixed fields; lists joined by ``; ``, null as empty."""
    out = [F.array_join(c, "; ").alias(c) if isinstance(df.schema[c].dataType, T.ArrayType) else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in fields or df.columns]
    df.select(*out).write.option("header", True).option("escape", '"').option("emptyValue", "").mode("overwrite").csv(path)


def geojson(df: DataFrame, key: str, lat: str, lon: str, properties: list[str]) -> DataFrame:
    """(key, feature): a GeoJSON point of each row with a position; null and empty properties are left out."""
    kept = {c: F.nullif(F.col(c), F.lit("")) if isinstance(df.schema[c].dataType, T.StringType) else F.col(c) for c in properties}
    shape = F.struct(F.lit("Point").alias("type"), F.array(F.round(F.col(lon), 7), F.round(F.col(lat), 7)).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(*(v.alias(c) for c, v in kept.items())).alias("properties"))
    return df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)).select(key, F.to_json(feature, {"ignoreNullFields": "true"}).alias("feature"))


def write_geojson(df: DataFrame, path: str, *args, **kw) -> None:
    """Newline-delimited GeoJSON features, one file a partition."""
    geojson(df, *args, **kw).select("feature").write.mode("overwrite").text(path)


def members(raw: bytes, name: str, depth: int = 0, left: list[int] | None = None) -> Iterator[tuple[str, bytes | None, str]]:
    """(name, bytes, reason) of the KML documents of a file or archive; refused members have a reason.

    Archives in archives are opened ``MAX_DEPTH`` deep. What all of them expand to together is bounded:
    once ``MAX_TOTAL_BYTES`` are used up, further members are refused.
    """
    left = [MAX_TOTAL_BYTES] if left is None else left
    if not zipfile.is_zipfile(io.BytesIO(raw)):
        yield (name, raw, "ok") if name.lower().endswith(".kml") or b"<kml" in raw[:4096] else (name, None, "not_kml")
        return
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        for info in archive.infolist():
            path, inner = PurePosixPath(info.filename), f"{name}!{info.filename}"
            if info.is_dir():
                continue
            if path.is_absolute() or ".." in path.parts or "\\" in info.filename:
                yield inner, None, "unsafe_path"
            elif info.file_size > MAX_BYTES or info.file_size > MAX_RATIO * max(1, info.compress_size):
                yield inner, None, "too_large"
            elif path.suffix.lower() in (".zip", ".kmz", ".kml") and info.file_size > left[0]:
                yield inner, None, "total_too_large"
            elif path.suffix.lower() in (".zip", ".kmz"):
                left[0] -= info.file_size
                if depth + 1 > MAX_DEPTH:
                    yield inner, None, "too_deep"
                else:
                    yield from members(archive.read(info), inner, depth + 1, left)
            elif path.suffix.lower() == ".kml":
                left[0] -= info.file_size
                yield inner, archive.read(info), "ok"


def placemarks(raw: bytes) -> Iterator[tuple[str, str, float | None, float | None, float | None]]:
    """(folder, name, longitude, latitude, altitude) of the placemarks of a KML document."""
    narrow = raw.replace(b"\0", b"").upper()  # of any encoding that is ASCII between zero bytes
    if b"<!DOCTYPE" in narrow or b"<!ENTITY" in narrow:
        raise ValueError("entities are not read")
    local = lambda e: e.tag.rpartition("}")[2]

    def walk(node: ElementTree.Element, path: tuple[str, ...]) -> Iterator:
        for child in node:
            kind = local(child)
            if kind in ("Folder", "Document", "kml"):
                title = next((c.text or "" for c in child if local(c) == "name"), "")
                yield from walk(child, (*path, title.strip()) if title.strip() else path)
            elif kind == "Placemark":
                name = next((c.text or "" for c in child if local(c) == "name"), "").strip()
                spots = [c.text for p in child.iter() if local(p) == "Point" for c in p if local(c) == "coordinates" and c.text]
                numbers: list[float | None] = [None, None, None]
                if len(spots) == 1:
                    for i, v in enumerate(spots[0].strip().split(",")[:3]):
                        try:
                            numbers[i] = float(v)
                        except ValueError:
                            numbers[i] = None
                yield "/".join(path), name, *numbers

    root = ElementTree.fromstring(raw)
    yield from walk([root] if local(root) != "kml" else root, ())  # type: ignore[arg-type]


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """Placemarks of KML, KMZ and ZIP files: file, member, status, folder, name, longitude, latitude, altitude.

    A refused or broken member is a row with its reason as ``status``; network links aren't followed.
    """
    names = ["file", "member", "status", "folder", "name", "longitude", "latitude", "altitude"]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file, raw in zip(pdf["path"], pdf["content"]):
                for member, body, reason in members(bytes(raw), file):
                    if body is None:
                        rows.append((file, member, reason, *[None] * 5))
                        continue
                    try:
                        rows += [(file, member, "ok", *p) for p in placemarks(body)]
                    except (ElementTree.ParseError, ValueError) as e:
                        rows.append((file, member, f"broken: {type(e).__name__}", *[None] * 5))
            yield pd.DataFrame(rows, columns=names)

    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    return raw.mapInPandas(parse, "file string, member string, status string, folder string, name string, longitude double, latitude double, altitude double")


def kml_text(rows: list[dict], title: str) -> str:
    """A KML document of points; for what is written on the driver, which is small by nature."""
    marks = "".join(f"<Placemark><name>{escape(str(r['name'] or ''))}</name><Point><coordinates>{r['longitude']:.7f},{r['latitude']:.7f},0</coordinates></Point></Placemark>" for r in rows)
    return f'<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>{escape(title)}</name>{marks}</Document></kml>'


def zip_bytes(files: dict[str, bytes]) -> bytes:
    """An archive that is the same for the same files: sorted, one time, one mode."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name in sorted(files):
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.external_attr, info.compress_type = 0o644 << 16, zipfile.ZIP_DEFLATED
            archive.writestr(info, files[name])
    return out.getvalue()


def canonical_json(value: object) -> str:
    """JSON with sorted keys and no blanks, for hashing."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def strict(df: DataFrame, required: Sequence[str], allowed: Sequence[str] = ()) -> DataFrame:
    """``df``, or an error that names the columns that are missing or unknown."""
    missing = [c for c in required if c not in df.columns]
    unknown = [c for c in df.columns if c not in {*required, *allowed}]
    if missing or unknown:
        raise ValueError(f"columns missing: {', '.join(missing) or 'none'}; unknown: {', '.join(unknown) or 'none'}")
    return df


def upsert_csv(spark: SparkSession, path: str, fresh: DataFrame, key: str, replace: bool = False) -> None:
    """Writes the rows of ``fresh`` into a CSV folder by key; readers see the old table or the new one, never half of it.

    The new table is written beside the old one and takes its name at the end. A key that is there
    already is an error unless ``replace``.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    there = fs.exists(where)
    rows = upsert(spark.read.option("header", True).schema(fresh.schema).csv(path), fresh, key, replace) if there else fresh
    beside, old = (spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}") for _ in range(2))
    rows.write.option("header", True).csv(beside.toString())
    if there:
        fs.rename(where, old)
    if not fs.rename(beside, where):
        fs.rename(old, where)
        raise OSError(f"{path} could not be replaced")
    if there:
        fs.delete(old, True)


def save_artifact(spark: SparkSession, root: str, text: str, suffix: str = ".json") -> tuple[str, bool]:
    """(path, was there): a text stored under the hash of its content; storing it again changes nothing."""
    digest = hashlib.sha256(text.encode()).hexdigest()
    path = f"{root.rstrip('/')}/{digest[:2]}/{digest}{suffix}"
    there = get_text(spark, path) is not None
    if not there:
        put_text(spark, path, text)
    return path, there
