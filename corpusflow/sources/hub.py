"""Repositories: metadata documents as rows, file listings, and a cache of blobs with links.

Fetching is a driver's affair. A transport is a callable from a URL to bytes or None; without a network it reads a folder.
"""

from __future__ import annotations

import contextlib
import fcntl
import hashlib
import json
import os
import shutil
import threading
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import trim_quotes
from . import catalog

LFS = "struct<sha256:string,size:bigint,pointerSize:bigint>"
INFO = (
    "id string, modelId string, model_id string, author string, sha string, lastModified timestamp, createdAt timestamp, private boolean, disabled boolean, gated string, "
    "downloads bigint, likes bigint, library_name string, pipeline_tag string, tags array<string>, usedStorage bigint, "
    f"siblings array<struct<rfilename:string,size:bigint,blobId:string,lfs:{LFS}>>, safetensors struct<parameters:map<string,bigint>,total:bigint>, config string, cardData string"
)


def repo_infos(documents: DataFrame, column: str = "value") -> DataFrame:
    """Metadata JSON texts as rows. `model_id` stands in where `modelId` is empty."""
    parsed = documents.select(F.from_json(column, INFO).alias("r")).select("r.*")
    return parsed.withColumn("modelId", F.coalesce(F.nullif(F.col("modelId"), F.lit("")), F.col("model_id"))).drop("model_id")


def read_infos(spark: SparkSession, path: str) -> DataFrame:
    return repo_infos(spark.read.text(path, wholetext=True))


def files(infos: DataFrame, strict: bool = False) -> DataFrame:
    """(repo, ordinal, name, size, blob_id, lfs) of every file listed; strict: a name that is absolute or has `..` is an error."""
    rows = infos.select(F.coalesce("id", "modelId").alias("repo"), F.posexplode("siblings").alias("ordinal", "s"))
    name = F.col("s.rfilename")
    if strict:
        bad = name.startswith("/") | name.contains("..")
        name = F.when(bad, F.raise_error(F.concat(F.lit("illegal file name "), name)).cast("string")).otherwise(name)
    lfs = F.when(F.col("s.lfs").isNotNull(), F.struct(F.col("s.lfs.sha256").alias("sha256"), F.col("s.lfs.size").alias("size"), F.col("s.lfs.pointerSize").alias("pointer_size")))
    return rows.select("repo", "ordinal", name.alias("name"), F.col("s.size").alias("size"), F.col("s.blobId").alias("blob_id"), lfs.alias("lfs"))


def has_file(listing: DataFrame, name: str) -> bool:
    return not listing.where(F.col("name") == name).isEmpty()


def file_metadata(headers: Column, url: Column, length: Column) -> Column:
    """struct(commit, etag, location, size) of a map of response headers, with lower-case names."""
    get = lambda k: F.nullif(F.try_element_at(headers, F.lit(k)), F.lit(""))
    size = F.nullif(F.coalesce(get("x-linked-size").try_cast("bigint"), F.lit(0).cast("bigint")), F.lit(0).cast("bigint"))
    return F.struct(
        F.coalesce(get("x-repo-commit"), F.lit("")).alias("commit"), trim_quotes(F.coalesce(get("x-linked-etag"), get("etag"), F.lit(""))).alias("etag"),
        F.coalesce(get("location"), url).alias("location"), F.coalesce(size, length).alias("size"),
    )


def default_cache_dir() -> str:
    home = os.environ.get("XDG_CACHE_HOME") or os.path.join(os.path.expanduser("~"), ".cache")
    return os.path.join(home, "corpusflow", "hub")


@contextlib.contextmanager
def locked(path: str) -> Iterator[None]:
    """Holds path.lock, so that processes take turns."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.lock", "w") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        yield


def folder_transport(root: str) -> Callable[[str], bytes | None]:
    """Serves URLs from files below root, by their path."""

    def get(url: str) -> bytes | None:
        path = os.path.join(root, url.partition("://")[2].partition("/")[2])
        if not os.path.isfile(path):
            return None
        with open(path, "rb") as f:
            return f.read()

    return get


@dataclass
class Repo:
    """A repository in the cache: blobs by their ETag, and snapshots whose files link to them."""

    id: str
    type: str = "models"
    revision: str = "main"
    endpoint: str = "https://localhost"
    cache_dir: str = field(default_factory=default_cache_dir)
    transport: Callable[[str], bytes | None] | None = None
    parallel: int = 20
    #: A URL's response headers, by lower-case names, or None: with them blobs go by their ETag and snapshots by their commit.
    head: Callable[[str], dict[str, str] | None] | None = None
    #: Called with a file's name and size when it is there; set `cancelled` to end a download before its next file.
    progress: Callable[[str, int], None] | None = None
    cancelled: threading.Event = field(default_factory=threading.Event)

    @property
    def folder(self) -> str:
        return os.path.join(self.cache_dir, "--".join([self.type, *self.id.split("/")]))

    def url(self, name: str) -> str:
        kind = "" if self.type == "models" else f"{self.type}/"
        return f"{self.endpoint}/{kind}{self.id}/resolve/{self.revision}/{name}"

    def info_url(self) -> str:
        return f"{self.endpoint}/api/{self.type}/{self.id}/revision/{self.revision}"

    def info(self, force: bool = False) -> dict:
        """The metadata document, kept in the cache."""
        path = os.path.join(self.folder, "info", f"{self.revision}.json")
        with locked(path):
            if force or not os.path.exists(path):
                self._put(path, self._get(self.info_url()))
        with open(path, encoding="utf-8") as f:
            return json.load(f)

    def names(self) -> list[str]:
        found = [s["rfilename"] for s in self.info().get("siblings") or []]
        if bad := [n for n in found if n.startswith("/") or ".." in n]:
            raise ValueError(f"illegal file name {bad[0]}")
        return found

    @property
    def snapshot(self) -> str:
        """The folder of the revision's files: that of the commit which the revision was last found to be, if headers told one."""
        at = os.path.join(self.folder, "refs", self.revision)
        if os.path.exists(at):
            with open(at, encoding="utf-8") as f:
                return os.path.join(self.folder, "snapshots", f.read())
        return os.path.join(self.folder, "snapshots", self.revision)

    def described(self, name: str) -> dict[str, str]:
        """commit, etag, location and size of a file as its headers have them, as file_metadata() reads them; empty without headers."""
        found = (self.head(self.url(name)) if self.head else None) or {}
        etag = found.get("x-linked-etag") or found.get("etag") or ""
        size = found.get("x-linked-size") or found.get("content-length") or ""
        return {"commit": found.get("x-repo-commit") or "", "etag": etag.removeprefix("W/").strip('"'), "location": found.get("location") or self.url(name), "size": size}

    def listing_url(self) -> str:
        return f"{self.endpoint}/parquet?dataset={self.id}"

    def catalog(self, spark: SparkSession, force: bool = False) -> DataFrame:
        """The file catalog: kept in the cache; where it isn't there yet, or with force, as the server lists it, or else made from the file names."""
        path = os.path.join(self.folder, "info", f"{self.revision}.files.json")
        with locked(path):
            if (force or not os.path.exists(path)) and (told := self.transport(self.listing_url()) if self.transport else None) is not None:
                self._put(path, told)
            elif force or not os.path.exists(path):
                listed = [(s["rfilename"], s.get("size")) for s in self.info(force).get("siblings") or []]
                rows = catalog.crawl(spark.createDataFrame(listed, "name string, size long"), self.id).orderBy("ordinal")
                self._put(path, json.dumps({"parquet_files": [r.asDict() for r in rows.collect()]}).encode())  # one repository's files
        with open(path, encoding="utf-8") as f:
            return catalog.files_frame(spark, f.read())

    def download_split(self, spark: SparkSession, config: str = "", split: str = "") -> list[str]:
        """The files of a config and split, "" for any, in catalog order."""
        return self.download([r["url"] for r in catalog.list_files(self.catalog(spark), config, split).select("url").collect()])

    def _get(self, url: str) -> bytes:
        if (found := self.transport(url) if self.transport else None) is None:
            raise FileNotFoundError(url)
        return found

    @staticmethod
    def _put(path: str, content: bytes) -> None:
        """Whole or not at all."""
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(f"{path}.part", "wb") as f:
            f.write(content)
        os.replace(f"{path}.part", path)

    def download(self, names: Iterable[str]) -> list[str]:
        """Local paths in the order of names; those that are there aren't fetched again. The first error ends it."""
        with ThreadPoolExecutor(self.parallel) as pool:
            return list(pool.map(self._download, list(names)))

    def _download(self, name: str) -> str:
        if self.cancelled.is_set():
            raise InterruptedError(f"{name}: the download was cancelled")
        told = self.described(name)
        if told["commit"]:
            with locked(ref := os.path.join(self.folder, "refs", self.revision)):
                self._put(ref, told["commit"].encode())
        path = os.path.join(self.snapshot, name)
        with locked(path):
            if not os.path.exists(path):
                blob = os.path.join(self.folder, "blobs", told["etag"] or "none")
                # What another revision or an interrupted download has fetched already isn't fetched again.
                if not told["etag"] or not os.path.exists(blob) or told["size"] and os.path.getsize(blob) != int(told["size"]):
                    content = self._get(told["location"])
                    if told["size"] and len(content) != int(told["size"]):
                        raise OSError(f"{name}: {len(content)} bytes instead of {told['size']}")
                    blob = blob if told["etag"] else os.path.join(self.folder, "blobs", hashlib.sha256(content).hexdigest())
                    self._put(blob, content)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                os.symlink(os.path.relpath(blob, os.path.dirname(path)), f"{path}.part")
                os.replace(f"{path}.part", path)
        if self.progress:
            self.progress(name, os.path.getsize(path))
        return path

    def downloaded(self, spark: SparkSession) -> DataFrame:
        """(filename, path, size) of the snapshot's files."""
        root = self.snapshot
        rows = [(os.path.relpath(p, root), p, os.path.getsize(p)) for d, _, fs in os.walk(root) for f in fs if not f.endswith((".lock", ".part")) for p in [os.path.join(d, f)]]
        return spark.createDataFrame(sorted(rows), "filename string, path string, size long")

    def cached_file(self, config: str = "", split: str = "", ending: str = ".parquet") -> str | None:
        """The first cached file by name of a config and split, "" for any, to learn a schema from; None without one."""
        root = self.snapshot
        found = sorted(os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs if f.endswith(ending))
        fits = (n for n in found if all(not w or f"/{w}/" in f"/{n}" or w in os.path.basename(n) for w in (config, split)))
        return next((os.path.join(root, n) for n in fits), None)

    def delete(self, config: str | None, split: str | None) -> int:
        """Cached files of a config and split, both of which must be said ("" for any); returns how many went."""
        if config is None or split is None:
            raise ValueError("say config and split, an empty string for any")
        root, gone = self.snapshot, 0
        for d, _, fs in os.walk(root):
            parts = os.path.relpath(d, root).split(os.sep)
            if (config in ("", parts[0])) and (split in ("", parts[1] if len(parts) > 1 else parts[0])):
                for f in fs:
                    path = os.path.join(d, f)
                    if os.path.islink(path):
                        with contextlib.suppress(OSError):
                            os.remove(os.path.realpath(path))
                        gone += 1
                    os.remove(path)
        return gone

    def clear(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)
