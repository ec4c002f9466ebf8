"""What a caller plugs in: readers of pages, models that answer to a schema, localizers, and stores of images.

All take and return DataFrames, so a plug-in chooses how its calls are spread over executors.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
from typing import Protocol, runtime_checkable
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@runtime_checkable
class PageReader(Protocol):
    """pages: doc_id, page_no, image and what else a reader needs. Returns doc_id, page_no, raw, truncated, error."""

    name: str

    def read(self, pages: DataFrame) -> DataFrame: ...


@runtime_checkable
class FieldModel(Protocol):
    """prompts: doc_id, batch_no, prompt. Returns doc_id, batch_no, answer (JSON in the shape of `schema`)."""

    def answer(self, prompts: DataFrame, schema: dict) -> DataFrame: ...


@runtime_checkable
class CitationLocalizer(Protocol):
    """targets: doc_id, page_no, path, value. Returns them with x0, y0, x1, y1, null where nothing was found."""

    def locate(self, targets: DataFrame) -> DataFrame: ...


@runtime_checkable
class ImageStore(Protocol):
    """images: any columns with `name` and `image`. Returns them with `url` in place of `image`."""

    def put(self, images: DataFrame) -> DataFrame: ...


_readers: dict[str, PageReader] = {}


def register(reader: PageReader) -> None:
    """Make a reader known by its name; a later one of that name takes its place."""
    _readers[reader.name] = reader


def reader(name: str) -> PageReader:
    if name not in _readers:
        raise KeyError(f"no reader is registered as {name!r}; there are {sorted(_readers)}")
    return _readers[name]


class InlineImages:
    """Images as data URLs; null stays null."""

    def __init__(self, kind: str = "image/png"):
        self.kind = kind

    def put(self, images: DataFrame) -> DataFrame:
        body = F.regexp_replace(F.base64("image"), r"\s", "")
        return images.withColumn("url", F.concat(F.lit(f"data:{self.kind};base64,"), body)).drop("image")


class FolderImages:
    """Images as files of a folder that all executors share; a name is written once, and again by a repeated task."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def put(self, images: DataFrame) -> DataFrame:
        folder = self.folder

        @F.pandas_udf("string")
        def written(names: pd.Series, bodies: pd.Series) -> pd.Series:
            import os

            os.makedirs(folder, exist_ok=True)
            out = []
            for name, body in zip(names, bodies, strict=True):
                path = None
                if name is not None and body is not None:
                    # names come from documents: only their last part counts
                    path = f"{folder}/{os.path.basename(name)}"
                    partial = f"{path}.{os.getpid()}.part"
                    with open(partial, "wb") as f:
                        f.write(body)
                    os.replace(partial, path)
                out.append(path)
            return pd.Series(out, dtype=object)

        return images.withColumn("url", written("name", "image")).drop("image")


class SignedUrls:
    """Time-limited URLs of an object store by the public version 4 signature of query strings."""

    def __init__(self, host: str, key_id: str, secret: str, region: str = "us-east-1", service: str = "s3"):
        self.host, self.key_id, self.secret, self.region, self.service = host, key_id, secret, region, service

    def url(self, method: str, path: str, at: datetime.datetime, seconds: int) -> str:
        """The URL for one call of `method` on /path within `seconds` of `at` (UTC)."""
        stamp, day = at.strftime("%Y%m%dT%H%M%SZ"), at.strftime("%Y%m%d")
        scope = f"{day}/{self.region}/{self.service}/aws4_request"
        query = {"X-Amz-Algorithm": "AWS4-HMAC-SHA256", "X-Amz-Credential": f"{self.key_id}/{scope}", "X-Amz-Date": stamp, "X-Amz-Expires": str(seconds), "X-Amz-SignedHeaders": "host"}
        text = "&".join(f"{quote(k, safe='')}={quote(v, safe='')}" for k, v in sorted(query.items()))
        place = "/" + quote(path.lstrip("/"), safe="/-_.~")
        request = f"{method}\n{place}\n{text}\nhost:{self.host}\n\nhost\nUNSIGNED-PAYLOAD"
        key = f"AWS4{self.secret}".encode()
        for part in (day, self.region, self.service, "aws4_request"):
            key = hmac.new(key, part.encode(), hashlib.sha256).digest()
        told = f"AWS4-HMAC-SHA256\n{stamp}\n{scope}\n{hashlib.sha256(request.encode()).hexdigest()}"
        return f"https://{self.host}{place}?{text}&X-Amz-Signature={hmac.new(key, told.encode(), hashlib.sha256).hexdigest()}"

    def sign(self, objects: DataFrame, method: str, at: datetime.datetime, seconds: int = 3600, column: str = "path") -> DataFrame:
        """objects with `url`; null paths have none."""
        signer = self

        @F.pandas_udf("string")
        def signed(paths: pd.Series) -> pd.Series:
            return pd.Series([None if p is None else signer.url(method, p, at, seconds) for p in paths], dtype=object)

        return objects.withColumn("url", signed(column))
