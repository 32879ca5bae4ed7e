"""Catalogs, scans, schemas, metadata and the cache."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions import names
from corpusflow.sources import catalog, hub, scan, schema

RECORD = "answers array<string>, passages struct<is_selected:array<int>,passage_text:array<string>,url:array<string>>, query string, query_id int, query_type string, wellFormedAnswers array<string>"


@pytest.fixture
def records(spark, tmp_path):
    rows = [([f"a{i}"], ([1, 0, 0], [f"p{i}", "", f"q{i}"], ["u", "v", "w"]), f"query {i}", i, "NUMERIC", []) for i in range(10)]
    spark.createDataFrame(rows, RECORD).coalesce(1).write.parquet(f"{tmp_path}/a")
    spark.createDataFrame([([], ([], [], []), "last", 10, "ENTITY", [])], RECORD).coalesce(1).write.parquet(f"{tmp_path}/b")
    return [f"{tmp_path}/a", f"{tmp_path}/b"]


def test_typed_scan(spark, records):
    assert [r["query_id"] for r in scan.scan(spark, records, RECORD).orderBy("query_id").collect()] == list(range(11))
    part = scan.scan(spark, records[0], "query string, passages struct<url:array<string>,extra:int>, absent int, query_id bigint")
    row = part.orderBy("query_id").first()
    assert row["passages"]["url"] == ["u", "v", "w"] and row["passages"]["extra"] is None and row["absent"] is None and row["query_id"] == 0
    assert "query_type" not in part._jdf.queryExecution().executedPlan().toString()
    assert scan.scan(spark, records[0], "absent int, words array<string>", zero_missing=True).first().asDict() == {"absent": 0, "words": []}
    with pytest.raises(ValueError):
        scan.scan(spark, [])
    out = scan.passages(scan.scan(spark, records, RECORD))
    assert out.count() == 20 and out.where("text = ''").count() == 0
    assert next(scan.records(scan.scan(spark, records, "query string").where("query = 'last'")))["query"] == "last"


def test_scan_from_any_row(spark, records):
    every = [r["query_id"] for r in scan.scan_from(spark, records, 0, "query_id int").collect()]
    assert every == list(range(11))
    for at in (-5, 3, 9, 10):
        assert [r["query_id"] for r in scan.scan_from(spark, records, at, "query_id int").collect()] == list(range(max(0, at), 11))
    assert scan.scan_from(spark, records, 99, "query_id int").count() == 0


def test_schema_report(spark):
    struct = T.StructType.fromDDL(RECORD)
    rows = {r["path"]: r for r in schema.report(spark, struct).collect()}
    assert [rows[p]["name"] for p in ("answers", "passages", "query", "query_id", "query_type", "wellFormedAnswers")] == ["Answers", "Passages", "Query", "QueryID", "QueryType", "WellFormedAnswers"]
    assert [rows[f"passages.{p}"]["name"] for p in ("is_selected", "passage_text", "url")] == ["IsSelected", "PassageText", "URL"]
    assert rows["passages.is_selected"]["physical_type"] == "INT32" and rows["answers"]["repeated"]
    made: dict = {}
    exec(schema.generate(struct, schema.record_name("me/my_url")), made)  # noqa: S102
    assert made["MyURLRecord"].__dataclass_fields__["passages"].type == "PassagesItem" or made["MyURLRecord"].__annotations__["passages"] in ("PassagesItem", made["PassagesItem"])


def test_catalog(spark):
    content = json.dumps({"parquet_files": [{"dataset": "d", "config": c, "split": s, "url": "u", "filename": f, "size": z} for c, s, f, z in (("x", "train", "0", 5), ("x", "test", "1", 6), ("y", "train", "2", 7))]})
    files = catalog.files_frame(spark, content)
    pick = lambda c, s: [r["filename"] for r in catalog.list_files(files, c, s).collect()]
    assert pick("", "") == ["0", "1", "2"] and pick("x", "") == ["0", "1"] and pick("", "train") == ["0", "2"] and pick("z", "") == []
    cached = spark.createDataFrame([("1",), ("1",)], "filename string")
    assert [r["filename"] for r in catalog.downloaded(files, cached).collect()] == ["1"] and catalog.missing(files, cached).count() == 2


def test_catalog_documents(spark, tmp_path):
    info = {"dataset_info": {"en": {"description": "d", "splits": {"train": {"num_bytes": 9, "num_examples": 3}}, "features": {"a": {"_type": "Sequence", "feature": {"_type": "Value", "dtype": "int32"}}, "b": {"_type": "X", "feature": {"c": {"_type": "Value", "dtype": "string"}}}, "w": {"_type": "Y", "feature": [1]}}}}}
    frames = catalog.info_frames(spark, json.dumps(info))
    assert frames["splits"].first()["num_examples"] == 3 and frames["configs"].first()["config"] == "en"
    specs = {r["name"]: json.loads(r["spec"]) for r in frames["features"].collect()}
    assert specs["a"] == info["dataset_info"]["en"]["features"]["a"] and specs["b"]["feature"]["c"]["dtype"] == "string" and "feature" not in specs["w"]
    files = spark.createDataFrame([(0, "d", "en", "train", "u", "f.parquet", 5)], "ordinal long, dataset string, config string, split string, url string, filename string, size long")
    catalog.write_files(files, f"{tmp_path}/catalog")
    assert catalog.read_files(spark, f"{tmp_path}/catalog").collect() == files.collect()


def test_crawl(spark):
    rows = [("a.parquet", 1), ("data/dev-0.parquet", 2), ("data/en/Valid.parquet", 3), ("sub/x/test.parquet", 4), ("x.json", 5), ("deep/en/odd.parquet", 6)]
    out = {(r["filename"], r["config"], r["split"]) for r in catalog.crawl(spark.createDataFrame(rows, "name string, size long"), "d").collect()}
    assert out == {("a.parquet", "default", "train"), ("dev-0.parquet", "default", "validation"), ("Valid.parquet", "en", "validation"), ("test.parquet", "sub-x", "test"), ("odd.parquet", "deep-en", "train")}
    known = spark.createDataFrame([("en", "odd"), ("en", "train"), ("sub-x", "dev")], "config string, split string")
    out = {(r["filename"], r["config"], r["split"]) for r in catalog.crawl(spark.createDataFrame(rows, "name string, size long"), "d", splits=known).collect()}
    assert ("odd.parquet", "en", "odd") in out and ("test.parquet", "sub-x", "test") in out


@pytest.mark.parametrize(("path", "want"), [("foo/../bar", "bar"), ("../foo/bar", "foo/bar"), ("foo/../../../..", "."), ("", "."), ("a/./b//c/", "a/b/c"), ("a/b/../../c", "c"), ("..", "."), ("a/..", ".")])
def test_clean_path(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(names.clean_path(F.col("p")).alias("p")).first()["p"] == want


def test_names(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(names.camel_case(F.lit("query_id"))) == "QueryID" and one(names.camel_case(F.lit("wellFormedAnswers"))) == "WellFormedAnswers"
    assert one(names.flat_folder_name(F.lit("datasets"), F.lit("a/b"))) == "datasets--a--b" and one(names.trim_quotes(F.lit('"x"'))) == "x"
    assert one(names.file_url("http://h/", "models", F.lit("a/b"), F.lit("r"), F.lit("f"))) == "http://h/a/b/resolve/r/f"
    assert tuple(one(names.map_tensor_name(F.lit("model.layers.12.self_attn.q_proj.weight")))) == ("layer_12/self_attn/MultiHeadAttention/query/dense", "weights")
    assert one(names.map_tensor_name(F.lit("what.weight"))) is None
    assert tuple(one(names.map_vision_tensor_name(F.lit("a.blocks.3.weight")))) == ("a/blocks/3", "weights") and one(names.map_vision_tensor_name(F.lit("x.layer_norm1.bias")))["variable"] == "offset"
    assert one(names.align_vision_name(F.lit("a/proj"), F.lit("weights"), F.lit(2))) == "a/proj/dense/weights"
    assert one(names.align_vision_name(F.lit("a/norm"), F.lit("biases"), F.lit(1))) == "a/norm/layer_normalization/offset"
    prompts = F.create_map(F.lit("q"), F.lit("Q: "))
    assert one(names.build_prompt(prompts, F.lit("q"), F.lit(""), F.lit("x"))) == "Q: x" == one(names.build_prompt(prompts, F.lit(""), F.lit("q"), F.lit("x"))) and one(names.build_prompt(prompts, F.lit("z"), F.lit("q"), F.lit("x"))) == "x"
    assert names.parse_color("Red") == (255, 0, 0) and names.parse_color("#010203") == (1, 2, 3) and names.parse_color("?") == (128, 128, 128)
    assert names.parse_numbers("1,2,1; 3,4,0", 3) == [[1, 2, 1], [3, 4, 0]] and names.indexed_path("a/b.png", 2) == "a/b_2.png"


def test_metadata(spark):
    doc = {"id": "a/b", "modelId": "", "model_id": "legacy", "lastModified": "2024-01-02T03:04:05.000Z", "tags": ["x"], "usedStorage": 7, "siblings": [{"rfilename": "m.safetensors", "size": 9, "lfs": {"sha256": "s", "size": 9, "pointerSize": 135}}, {"rfilename": "c.json"}], "safetensors": {"total": 3, "parameters": {"F32": 3}}}
    infos = hub.repo_infos(spark.createDataFrame([(json.dumps(doc),)], "value string"))
    row = infos.first()
    assert row["modelId"] == "legacy" and row["safetensors"]["total"] == 3 and row["lastModified"] == datetime(2024, 1, 2, 3, 4, 5)
    files = hub.files(infos, strict=True)
    assert [(r["name"], r["lfs"] and r["lfs"]["pointer_size"]) for r in files.orderBy("ordinal").collect()] == [("m.safetensors", 135), ("c.json", None)] and hub.has_file(files, "c.json")
    bad = hub.repo_infos(spark.createDataFrame([(json.dumps({"id": "x", "siblings": [{"rfilename": "../x"}]}),)], "value string"))
    with pytest.raises(Exception, match="illegal file name"):
        hub.files(bad, strict=True).collect()
    headers = F.create_map(*(F.lit(x) for x in ("etag", '"e"', "x-linked-size", "12")))
    meta = spark.range(1).select(hub.file_metadata(headers, F.lit("u"), F.lit(5).cast("long")).alias("m")).first()["m"]
    assert (meta["etag"], meta["location"], meta["size"]) == ("e", "u", 12)


def test_cache(spark, tmp_path):
    root = tmp_path / "served/datasets/a/b/resolve/main"
    (root / "en/train").mkdir(parents=True)
    (root / "en/train/0.parquet").write_bytes(b"xyz")
    api = tmp_path / "served/api/datasets/a/b/revision"
    api.mkdir(parents=True)
    (api / "main").write_text(json.dumps({"siblings": [{"rfilename": "en/train/0.parquet"}]}))
    repo = hub.Repo("a/b", "datasets", endpoint="http://h", cache_dir=str(tmp_path / "cache"), transport=hub.folder_transport(str(tmp_path / "served")))
    paths = repo.download(repo.names())
    assert open(paths[0], "rb").read() == b"xyz" and repo.download(repo.names()) == paths
    assert repo.downloaded(spark).first()["filename"] == "en/train/0.parquet"
    with pytest.raises(FileNotFoundError):
        repo.download(["none"])
    with pytest.raises(ValueError):
        repo.delete(None, "")
    assert repo.delete("en", "train") >= 1 and repo.downloaded(spark).count() == 0


class Served:
    """A repository of bytes by name, with headers, that counts what is fetched; its listing of Parquet files may be missing."""

    listing: bytes | None = None

    def __init__(self, files, commit="c1"):
        import hashlib

        self.files, self.commit, self.fetched, self.etag = files, commit, [], lambda x: hashlib.md5(x).hexdigest()

    def get(self, url):
        if "/parquet?" in url:
            return self.listing
        if "/api/" in url:
            return json.dumps({"id": "a/b", "siblings": [{"rfilename": n, "size": len(x)} for n, x in self.files.items()]}).encode()
        self.fetched.append(name := url.partition("/resolve/main/")[2])
        return self.files.get(name)

    def head(self, url):
        x = self.files.get(url.partition("/resolve/main/")[2])
        return None if x is None else {"x-repo-commit": self.commit, "etag": f'W/"{self.etag(x)}"', "content-length": str(len(x))}


def test_downloads_by_headers(spark, tmp_path):
    served, seen = Served({"data/train-0.parquet": b"abc", "data/test-0.parquet": b"de", "copy.parquet": b"abc", "x.json": b"{}"}), []
    repo = hub.Repo("a/b", "datasets", cache_dir=str(tmp_path), transport=served.get, head=served.head, progress=lambda n, size: seen.append((n, size)), parallel=1)
    catalog_rows = repo.catalog(spark).collect()
    assert [(r["config"], r["split"], r["filename"]) for r in catalog_rows] == [("default", "train", "copy.parquet"), ("default", "test", "test-0.parquet"), ("default", "train", "train-0.parquet")]
    served.files["late.parquet"] = b"z"
    assert len(repo.catalog(spark).collect()) == 3 and len(repo.catalog(spark, force=True).collect()) == 4  # kept, and crawled again
    paths = repo.download_split(spark, "default", "test")
    assert [open(p, "rb").read() for p in paths] == [b"de"] and "/snapshots/c1/" in paths[0] and served.fetched == ["data/test-0.parquet"] and seen == [("data/test-0.parquet", 2)]
    repo.download(["data/train-0.parquet", "copy.parquet", "data/test-0.parquet"])
    assert served.fetched == ["data/test-0.parquet", "data/train-0.parquet"]  # equal bytes have one ETag
    served.commit, served.files["data/test-0.parquet"] = "c2", b"new"
    later = repo.download(["data/train-0.parquet", "data/test-0.parquet"])
    assert "/snapshots/c2/" in later[0] and open(later[1], "rb").read() == b"new" and served.fetched[2:] == ["data/test-0.parquet"]
    assert {r["filename"] for r in repo.downloaded(spark).collect()} == {"data/train-0.parquet", "data/test-0.parquet"}
    assert repo.cached_file("", "test").endswith("c2/data/test-0.parquet") and repo.cached_file("none") is None
    served.listing = json.dumps({"parquet_files": [{"dataset": "a/b", "config": "x", "split": "y", "url": "u", "filename": "f", "size": 3}]}).encode()
    assert [tuple(r)[1:5] for r in repo.catalog(spark, force=True).collect()] == [("a/b", "x", "y", "u")]
    repo.cancelled.set()
    with pytest.raises(InterruptedError):
        repo.download(["x.json"])
    short = hub.Repo("a/b", "datasets", cache_dir=str(tmp_path / "x"), transport=lambda u: b"", head=served.head)
    with pytest.raises(OSError, match="instead of"):
        short.download(["x.json"])
