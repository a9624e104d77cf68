"""Image tags: EXIF directories and the XMP packet by name, which tags a frame is made of, and writing EXIF positions."""

from __future__ import annotations

import re
import struct
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass, fields

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.functions import geo
from skylattice.operators.export import frame_number
from skylattice.sources.images import ALT, DATE, GPS_POINTER, HEADING, LAT, LAT_REF, LON, LON_REF, MODEL, _directory
from skylattice.sources.settings import load


@dataclass(frozen=True)
class FrameTags:
    """The tag that each value of a frame is read from: Exif.<directory>.<name> or Xmp.<prefix>.<name>."""

    timestamp: str = "Exif.Image.DateTime"
    camera_id: str = "Exif.Image.Model"
    heading: str = "Exif.GPSInfo.GPSImgDirection"
    latitude: str = "Exif.GPSInfo.GPSLatitude"
    latituderef: str = "Exif.GPSInfo.GPSLatitudeRef"
    longitude: str = "Exif.GPSInfo.GPSLongitude"
    longituderef: str = "Exif.GPSInfo.GPSLongitudeRef"
    altitude: str = "Exif.GPSInfo.GPSAltitude"


#: Numbers of the EXIF tags by name (fixed values).
IMAGE_TAGS = {"Make": 0x010F, "Model": MODEL, "Orientation": 0x0112, "Software": 0x0131, "DateTime": DATE, "Artist": 0x013B}
GPS_TAGS = {"GPSLatitudeRef": LAT_REF, "GPSLatitude": LAT, "GPSLongitudeRef": LON_REF, "GPSLongitude": LON, "GPSAltitudeRef": 5, "GPSAltitude": ALT, "GPSTimeStamp": 7, "GPSImgDirection": HEADING}
_PACKET = re.compile(rb"<(\w+:)?RDF\b.*?</(\w+:)?RDF>", re.S)
_PREFIX = re.compile(rb"xmlns:(\w+)\s*=\s*[\"']([^\"']+)[\"']")


def load_tags(text: str) -> FrameTags:
    """Tag names from YAML text; names that it lacks keep their defaults."""
    return load(text, FrameTags())


def is_xmp(tag: str) -> bool:
    return tag.split(".", 1)[0] == "Xmp"


def exif_tags(data: bytes) -> dict[str, object]:
    """Values of the EXIF segment by tag name."""
    at = data.find(b"Exif\0\0")
    tiff = data[at + 6 :] if at >= 0 else b""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None:
        return {}
    try:
        main = _directory(tiff, struct.unpack_from(order + "I", tiff, 4)[0], order)
        gps = _directory(tiff, main[GPS_POINTER][0], order) if GPS_POINTER in main else {}
    except struct.error:
        return {}
    named = {f"Exif.Image.{n}": main[k] for n, k in IMAGE_TAGS.items() if k in main}
    return named | {f"Exif.GPSInfo.{n}": gps[k] for n, k in GPS_TAGS.items() if k in gps}


def xmp_tags(data: bytes) -> dict[str, str]:
    """Simple values of the XMP packet, as attributes or elements of its descriptions, by tag name."""
    packet = _PACKET.search(data)
    if packet is None:
        return {}
    before = data[: packet.start()].rfind(b"<x:xmpmeta")
    spaces = {u.decode(): p.decode() for p, u in _PREFIX.findall(data[max(0, before) : packet.end()])}
    text = packet[0].decode("utf-8", "replace")
    missing = [f'xmlns:{p}="{u}"' for u, p in spaces.items() if f"xmlns:{p}=" not in text]
    try:
        root = ET.fromstring(re.sub(r"^<([\w:]+)", lambda m: f"<{m[1]} {' '.join(missing)}", text, count=1))
    except ET.ParseError:
        return {}
    out: dict[str, str] = {}
    for description in root:
        found = [*description.attrib.items(), *((e.tag, e.text or "") for e in description if not len(e))]
        for name, value in found:
            space, _, local = name[1:].partition("}") if name.startswith("{") else ("", "", name)
            out[f"Xmp.{spaces.get(space, space)}.{local}"] = value
    return out


def tags_of(data: bytes) -> dict[str, object]:
    """All values of an image by tag name."""
    return exif_tags(data) | xmp_tags(data)


def _number(value) -> float | None:
    """A number from a list of rationals, or from text such as "1" or "3/4"."""
    if isinstance(value, list):
        return float(value[0]) if value else None
    try:
        a, _, b = str(value).strip().partition("/")
        return float(a) / float(b) if b else float(a)
    except (ValueError, ZeroDivisionError):
        return None


def _angle(value, side) -> float | None:
    """Decimal degrees from degrees, minutes and seconds, or from text such as "52,16.5N"."""
    if isinstance(value, list) and len(value) == 3:
        d = value[0] + value[1] / 60 + value[2] / 3600
    elif isinstance(value, str) and (m := re.match(r"\s*([\d.]+),\s*([\d.]+)(?:,\s*([\d.]+))?\s*([NSEW]?)", value)):
        d, side = float(m[1]) + float(m[2]) / 60 + float(m[3] or 0) / 3600, m[4] or side
    else:
        n = _number(value) if value is not None else None
        if n is None:
            return None
        d = n
    return -d if str(side or "").strip().upper()[:1] in ("S", "W") else d


def frame_values(data: bytes, tags: FrameTags) -> tuple:
    """camera_id, timestamp, latitude, longitude, altitude and heading of an image; numbers are 0 where a tag is missing."""
    got = tags_of(data)
    lat, lon = _angle(got.get(tags.latitude), got.get(tags.latituderef)), _angle(got.get(tags.longitude), got.get(tags.longituderef))
    numbers = [_number(got[t]) if t in got else None for t in (tags.altitude, tags.heading)]
    named = [None if t not in got else str(got[t]) for t in (tags.camera_id, tags.timestamp)]
    return (named[0] or "unknown_id", named[1], lat or 0.0, lon or 0.0, numbers[0] or 0.0, numbers[1] or 0.0)


def _images(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(folder).select("path", "content")


def read_tagged_frames(spark: SparkSession, folder: str, suffix: str = ".jpg", tags: FrameTags | None = None) -> DataFrame:
    """path, frame_id, camera_id, timestamp, latitude, longitude, altitude, heading and zone, band, easting, northing of every image of a folder."""
    chosen = tags or FrameTags()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *frame_values(bytes(b), chosen)) for p, b in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "camera_id", "timestamp", "latitude", "longitude", "altitude", "heading"])

    schema = "path string, camera_id string, timestamp string, latitude double, longitude double, altitude double, heading double"
    found = _images(spark, folder, suffix).mapInPandas(parse, schema).withColumn("frame_id", frame_number("path"))
    zoned = found.withColumn("zone", F.expr(geo.utm_zone("latitude", "longitude"))).withColumn("band", F.expr(geo.utm_band("latitude")))
    return geo.with_steps(zoned, geo.utm_forward("latitude", "longitude", "zone"))


def probed(spark: SparkSession, folder: str, suffix: str = ".jpg", tags: FrameTags | None = None) -> DataFrame:
    """path and a map from each of the frame's eight tags to whether the image has it."""
    names = [getattr(tags or FrameTags(), f.name) for f in fields(FrameTags)]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [tags_of(bytes(b)) for b in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "tags": [{n: n in got for n in names} for got in found]})

    return _images(spark, folder, suffix).mapInPandas(parse, "path string, tags map<string,boolean>")


def gps_rationals(degrees: Column) -> list[Column]:
    """Degrees, minutes and 1/1000 seconds of an angle without its sign."""
    thousandths = F.round(F.abs(degrees) * 3_600_000).cast("long")
    return [F.floor(thousandths / 3_600_000), F.floor(thousandths / 60_000) % 60, thousandths % 60_000]


def exif_segment(camera: str | None, taken: str | None, latitude: float, longitude: float, altitude: float, heading: float) -> bytes:
    """The EXIF segment (with its marker) of an image with these values."""

    def angle(x: float) -> bytes:
        t = round(abs(x) * 3_600_000)
        return struct.pack("<6I", t // 3_600_000, 1, t // 60_000 % 60, 1, t % 60_000, 1000)

    def ratio(x: float) -> bytes:
        return struct.pack("<2I", round(abs(x) * 1000), 1000)

    def directory(entries: list[tuple[int, int, int, bytes]], at: int) -> bytes:
        place, head, tail = at + 2 + 12 * len(entries) + 4, [struct.pack("<H", len(entries))], []
        for tag, kind, count, raw in sorted(entries):
            if len(raw) <= 4:
                head.append(struct.pack("<HHI", tag, kind, count) + raw.ljust(4, b"\0"))
            else:
                head.append(struct.pack("<HHII", tag, kind, count, place))
                raw += b"\0" * (len(raw) % 2)
                place += len(raw)
                tail.append(raw)
        return b"".join([*head, b"\0\0\0\0", *tail])

    text = lambda tag, s: [(tag, 2, len(s.encode()) + 1, s.encode() + b"\0")] if s else []
    main = text(MODEL, camera) + text(DATE, taken)
    gps_at = 8 + len(directory([*main, (GPS_POINTER, 4, 1, b"\0" * 4)], 8))
    gps = [
        (LAT_REF, 2, 2, b"S\0" if latitude < 0 else b"N\0"), (LAT, 5, 3, angle(latitude)), (LON_REF, 2, 2, b"W\0" if longitude < 0 else b"E\0"), (LON, 5, 3, angle(longitude)),
        (5, 1, 1, bytes([altitude < 0])), (ALT, 5, 1, ratio(altitude)), (HEADING, 5, 1, ratio(heading)),
    ]
    tiff = b"II*\0" + struct.pack("<I", 8) + directory([*main, (GPS_POINTER, 4, 1, struct.pack("<I", gps_at))], 8) + directory(gps, gps_at)
    return b"\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff


def with_exif(images: DataFrame) -> DataFrame:
    """images (content: JPEG bytes; camera_id, timestamp, latitude, longitude, altitude, heading) with an EXIF segment in content, in place of one it has."""

    @F.pandas_udf("binary")
    def tagged(content: pd.Series, camera: pd.Series, taken: pd.Series, lat: pd.Series, lon: pd.Series, alt: pd.Series, heading: pd.Series) -> pd.Series:
        out = []
        for data, *values in zip(content, camera, taken, lat, lon, alt, heading, strict=True):
            data = bytes(data)
            if data[2:4] == b"\xff\xe1" and data[6:12] == b"Exif\0\0":
                data = data[:2] + data[4 + struct.unpack(">H", data[4:6])[0] :]
            out.append(data[:2] + exif_segment(*values) + data[2:])
        return pd.Series(out)

    return images.withColumn("content", tagged("content", "camera_id", "timestamp", "latitude", "longitude", "altitude", "heading"))
