"""Document sources and result sinks: files by size and kind, results by batch and item."""

from __future__ import annotations

import io
import ipaddress
import struct
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.text import kind_from_name

#: Bytes of a file that sniffing may need beyond its signature.
MAX_BYTES = 150 * 1024 * 1024
# Brands of HEIF images and networks that downloads must not reach.
HEIF_BRANDS = (b"heic", b"heix", b"hevc", b"hevx", b"heim", b"heis", b"mif1", b"msf1", b"heif")
BLOCKED = tuple(map(ipaddress.ip_network, ("100.64.0.0/10", "2002::/16")))


def is_heif(head: bytes) -> bool:
    """An ftyp box with a HEIF brand, major or compatible, inside the box."""
    if len(head) < 12 or head[4:8] != b"ftyp":
        return False
    size = struct.unpack(">I", head[:4])[0]
    box = head[: size if 16 <= size <= len(head) else len(head)]
    brands = [box[8:12], *(box[i : i + 4] for i in range(16, len(box) - 3, 4))]
    return any(b in HEIF_BRANDS for b in brands)


def office_kind(data: bytes) -> str | None:
    """docx or pptx by the folders in a ZIP's directory; null if both or neither."""
    try:
        names = zipfile.ZipFile(io.BytesIO(data)).namelist()
    except (zipfile.BadZipFile, ValueError, OSError):
        return None
    word, deck = (any(n.startswith(p) for n in names) for p in ("word/", "ppt/"))
    return None if word == deck else "docx" if word else "pptx"


def kind_from_magic(data: bytes | None) -> str | None:
    if not data:
        return None
    if data[:1024].lstrip(b"\x00\t\n\x0c\r ").startswith(b"%PDF-"):
        return "pdf"
    if data.startswith(b"PK\x03\x04"):
        return office_kind(data)
    image = data.startswith((b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"II*\x00", b"MM\x00*")) or (data[:4] == b"RIFF" and data[8:12] == b"WEBP") or (data[:2] == b"BM" and len(data) >= 26) or is_heif(data)
    return "image" if image else None


def with_kinds(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """files with `kind`: by signature first, by name where there is none."""

    def sniff(batches):
        for batch in batches:
            i = batch.schema.get_field_index(content)
            yield batch.append_column("magic", pa.array([kind_from_magic(v) for v in batch.column(i).to_pylist()], pa.string()))

    known = files.mapInArrow(sniff, files.withColumn("magic", F.lit(None).cast("string")).schema)
    return known.withColumn("kind", F.coalesce("magic", kind_from_name(F.col(name)))).drop("magic")


def load_files(spark: SparkSession, path: str, most: int = MAX_BYTES) -> DataFrame:
    """Files under a path with their bytes; `length` is tested before content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= most)


def is_blocked_address(address: str) -> bool:
    """Not a public address: downloads to it are refused."""
    try:
        ip = ipaddress.ip_address(address)
    except ValueError:
        return True
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved or ip.is_unspecified or any(ip in n for n in BLOCKED if n.version == ip.version)


def read_once(images: DataFrame, read) -> DataFrame:
    """Apply `read` (DataFrame of sha, image to DataFrame of sha and results) once per distinct image."""
    keyed = images.withColumn("sha", F.sha2("image", 256))
    return keyed.join(read(keyed.select("sha", "image").dropDuplicates(["sha"])), "sha")


def as_response(columns: list[str], optional: list[str]) -> Column:
    """JSON of a row with nulls kept, but the optional blocks absent where they are null."""
    whole = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    for name in optional:
        whole = F.regexp_replace(whole, rf',"{name}":null|"{name}":null,|"{name}":null', "")
    return whole


def write_results(results: DataFrame, path: str) -> None:
    """One JSON line per item in a folder per batch."""
    results.write.mode("append").partitionBy("batch_id").json(path)
