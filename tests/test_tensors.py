"""Containers built by hand; blocks decoded by slow scalar code."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.sources import dequant, tensors


def safetensors(path, items, metadata=None):
    header, data = ({"__metadata__": metadata} if metadata else {}), b""
    for name, a in items.items():
        header[name] = {"dtype": {"f4": "F32", "i8": "I64", "f8": "F64"}[a.dtype.str[1:]], "shape": list(a.shape), "data_offsets": [len(data), len(data) + a.nbytes]}
        data += a.tobytes()
    head = json.dumps(header).encode()
    path.write_bytes(struct.pack("<Q", len(head)) + head + data)


def gguf(path, values, infos, data, version=3, magic=b"GGUF"):
    text = lambda s: struct.pack("<Q", len(s.encode())) + s.encode()
    out = magic + struct.pack("<IQQ", version, len(infos), len(values))
    for key, kind, raw in values:
        out += text(key) + struct.pack("<I", kind) + raw
    for name, shape, kind, offset in infos:
        out += text(name) + struct.pack("<I", len(shape)) + b"".join(struct.pack("<Q", d) for d in shape) + struct.pack("<IQ", kind, offset)
    path.write_bytes(out + b"\0" * (-len(out) % 32) + data)


def test_safetensors(spark, tmp_path):
    a, b = np.arange(6, dtype="<f4").reshape(2, 3), np.arange(4, dtype="<i8")
    safetensors(tmp_path / "one.safetensors", {"a": a, "b": b}, {"format": "pt"})
    safetensors(tmp_path / "two.safetensors", {"c": a * 2})
    rows = {r["name"]: r for r in tensors.tensors(spark, str(tmp_path)).collect()}
    assert rows["a"]["data"] == a.tobytes() and rows["b"]["dtype"] == "I64" and rows["c"]["shape"] == [2, 3] and rows["c"]["file"] == "two.safetensors"
    assert [r["name"] for r in tensors.tensors(spark, str(tmp_path)).where("name = 'b'").collect()] == ["b"]
    assert tensors.tensors(spark, str(tmp_path), data=False).where("data is not null").count() == 0
    assert tensors.safetensors_metadata(spark, str(tmp_path)).collect()[0]["value"] == "pt"
    assert {(r["name"], r["file"]) for r in tensors.shard_index(spark, str(tmp_path)).collect()} == {("a", "one.safetensors"), ("b", "one.safetensors"), ("c", "two.safetensors")}
    (tmp_path / "model.safetensors.index.json").write_text(json.dumps({"weight_map": {"a": "one.safetensors", "c": "two.safetensors"}}))
    assert sorted(r["name"] for r in tensors.sharded(spark, str(tmp_path)).collect()) == ["a", "c"]


@pytest.mark.parametrize("spec", [{"a": {"dtype": "F32", "shape": [2], "data_offsets": [0, 4]}}, {"a": {"dtype": "X9", "shape": [1], "data_offsets": [0, 4]}}])
def test_bad_safetensors(spec, tmp_path):
    import io

    head = json.dumps(spec).encode()
    with pytest.raises(ValueError):
        tensors.read_safetensors_header(io.BytesIO(struct.pack("<Q", len(head)) + head))
    with pytest.raises(ValueError):
        tensors.read_safetensors_header(io.BytesIO(struct.pack("<Q", 1 << 40)))


def test_gguf(spark, tmp_path):
    text = lambda s: struct.pack("<Q", len(s)) + s.encode()
    values = [
        ("general.architecture", 8, text("llama")), ("n", 4, struct.pack("<I", 7)), ("yes", 7, b"\1"), ("big", 10, struct.pack("<Q", 1 << 63)),
        ("names", 9, struct.pack("<IQ", 8, 2) + text("a") + text("b")),
    ]
    a, b = np.arange(12, dtype="<f4"), np.arange(32, dtype="<f4")
    gguf(tmp_path / "m.gguf", values, [("late", (32,), 0, 64), ("early", (3, 4), 0, 0), ("empty", (), 0, 192)], a.tobytes().ljust(64, b"\0") + b.tobytes())
    rows = {r["name"]: r for r in tensors.gguf_shapes(tensors.tensors(spark, str(tmp_path / "m.gguf"), "gguf")).collect()}
    assert rows["early"]["data"] == a.tobytes() and rows["late"]["data"] == b.tobytes()  # though the file has them in another order
    assert rows["early"]["dims"] == [4, 3] and rows["early"]["elements"] == 12 and rows["empty"]["elements"] == 0
    kv = {r["key"]: r for r in tensors.gguf_values(spark, str(tmp_path)).collect()}
    assert kv["general.architecture"]["string_value"] == "llama" and kv["n"]["long_value"] == 7 and kv["yes"]["bool_value"] is True
    assert kv["big"]["long_value"] is None and json.loads(kv["big"]["json_value"]) == 1 << 63 and json.loads(kv["names"]["json_value"]) == ["a", "b"]
    for magic, version in ((b"GGUF", 1), (b"NOPE", 3)):
        gguf(tmp_path / "bad.gguf", [], [], b"", version, magic)
        with pytest.raises(ValueError), open(tmp_path / "bad.gguf", "rb") as f:
            tensors.GGUF(f)


def half(x):
    return float(np.frombuffer(bytes(x), "<f2")[0])


def slow_k_scales(p):
    out = []
    for j in range(8):
        out.append((p[j] & 63, p[j + 4] & 63) if j < 4 else ((p[j + 4] & 15) | (p[j - 4] >> 6 << 4), (p[j + 4] >> 4) | (p[j] >> 6 << 4)))
    return out


def slow(kind, b):
    """One block, value by value, from the formats' definitions."""
    if kind == "Q8_0":
        return [half(b[:2]) * np.int8(np.uint8(x)) for x in b[2:]]
    if kind in ("Q4_0", "Q4_1"):
        q = b[2:] if kind == "Q4_0" else b[4:]
        v = [x & 15 for x in q] + [x >> 4 for x in q]
        return [half(b[:2]) * (x - 8) for x in v] if kind == "Q4_0" else [half(b[:2]) * x + half(b[2:4]) for x in v]
    if kind in ("Q5_0", "Q5_1"):
        o = 2 if kind == "Q5_0" else 4
        h, q = int.from_bytes(b[o : o + 4], "little"), b[o + 4 :]
        v = [(x & 15) | (h >> i & 1) << 4 for i, x in enumerate(q)] + [(x >> 4) | (h >> i + 16 & 1) << 4 for i, x in enumerate(q)]
        return [half(b[:2]) * (x - 16) for x in v] if kind == "Q5_0" else [half(b[:2]) * x + half(b[2:4]) for x in v]
    out = []
    if kind == "Q2_K":
        s, q, d, m = b[:16], b[16:80], half(b[80:82]), half(b[82:84])
        for i in range(256):
            n, r = divmod(i, 128)
            shift, l = divmod(r, 32)
            sc = s[i // 16]
            out.append(d * (sc & 15) * (q[32 * n + l] >> 2 * shift & 3) - m * (sc >> 4))
    if kind == "Q3_K":
        h, q, p, d = b[:32], b[32:96], b[96:108], half(b[108:110])
        for i in range(256):
            n, r = divmod(i, 128)
            shift, l = divmod(r, 32)
            k = i // 16
            sc = ((p[k] & 15) if k < 8 else (p[k - 8] >> 4)) | (p[8 + k % 4] >> 2 * (k // 4) & 3) << 4
            out.append(d * (sc - 32) * ((q[32 * n + l] >> 2 * shift & 3) - (0 if h[l] >> (4 * n + shift) & 1 else 4)))
    if kind in ("Q4_K", "Q5_K"):
        d, m, s = half(b[:2]), half(b[2:4]), slow_k_scales(b[4:16])
        q, h = (b[16:], None) if kind == "Q4_K" else (b[48:], b[16:48])
        for i in range(256):
            j, l = divmod(i, 32)
            v = q[32 * (j // 2) + l] >> 4 * (j % 2) & 15
            out.append(d * s[j][0] * (v | ((h[l] >> j & 1) << 4 if h else 0)) - m * s[j][1])
    if kind == "Q6_K":
        lo, hi, s, d = b[:128], b[128:192], np.frombuffer(bytes(b[192:208]), np.int8), half(b[208:210])
        for i in range(256):
            n, r = divmod(i, 128)
            j, l = divmod(r, 32)
            v = lo[64 * n + 32 * (j % 2) + l] >> 4 * (j // 2) & 15
            out.append(d * int(s[i // 16]) * ((v | (hi[32 * n + l] >> 2 * j & 3) << 4) - 32))
    return out


@pytest.mark.parametrize("kind", list(dequant.BLOCKS))
def test_blocks(kind):
    t = dequant.BY_NAME[kind]
    rng = np.random.default_rng(7)
    raw = rng.integers(0, 256, 3 * t.size, dtype=np.uint8)
    halves = {"Q2_K": (80, 82), "Q3_K": (108,), "Q6_K": (208,), "Q4_K": (0, 2), "Q5_K": (0, 2), "Q4_1": (0, 2), "Q5_1": (0, 2)}.get(kind, (0,))
    for n in range(3):
        for o in halves:
            raw[n * t.size + o : n * t.size + o + 2] = np.frombuffer(np.float16(0.25 * (n + 1)).tobytes(), np.uint8)
    want = [x for n in range(3) for x in slow(kind, raw[n * t.size : (n + 1) * t.size].tolist())]
    assert np.allclose(dequant.dequantize(kind, raw.tobytes()), want, rtol=1e-6, atol=1e-6)


def test_other_types(spark):
    assert dequant.dequantize("F16", np.float16([1.5, -2]).tobytes()).tolist() == [1.5, -2.0]
    assert dequant.dequantize("BF16", b"\xc0\x3f").tolist() == [1.5] and dequant.dequantize("I8", b"\xff").tolist() == [-1]
    for kind, raw in (("Q8_0", b"\0" * 33), ("IQ2_XXS", b"\0" * 66)):
        with pytest.raises(ValueError):
            dequant.dequantize(kind, raw)
    df = spark.createDataFrame([("F32", np.float32([1, 2]).tobytes()), ("Q8_0", b"\0"), ("F32", None)], "k string, raw binary")
    rows = df.select(dequant.gguf_dequantize(F.col("k"), F.col("raw")).alias("d")).select("d.*").collect()
    assert rows[0]["values"] == [1.0, 2.0] and rows[1]["values"] is None and "Q8_0" in rows[1]["error"] and rows[2]["values"] is None
    table = {r["name"]: (r["block_size"], r["type_size"]) for r in dequant.type_table(spark).collect()}
    assert table["F32"] == (1, 4) and table["Q4_0"] == (32, 18) and table["Q8_0"] == (32, 34) and table["Q4_K"] == (256, 144) and table["Q6_K"] == (256, 210)


def test_files_in_stretches(spark, tmp_path, monkeypatch):
    """Each tensor is read once, by the task in whose stretch it starts, and a shard's come by offset."""
    items = {f"t{i}": np.full(50 * (i % 3), i, "<f4") for i in range(40)}
    safetensors(tmp_path / "m.safetensors", items)
    monkeypatch.setattr(tensors, "TASK_BYTES", 700)
    reader = tensors.TensorReader({"path": str(tmp_path)}, "safetensors")
    parts = reader.partitions()
    rows = [r for p in parts for r in reader.read(p)]
    assert len(parts) > 5 and [r[1] for r in rows] == [t.name for t in tensors.read_safetensors_header(open(tmp_path / "m.safetensors", "rb"))[0]] and all(items[r[1]].tobytes() == r[6] for r in rows)
    assert [(r["name"], r["at"]) for r in tensors.in_order(tensors.tensors(spark, str(tmp_path), data=False)).collect()] == [(r[1], i) for i, r in enumerate(rows)]


@pytest.mark.parametrize("kind", ["safetensors", "gguf"])
def test_tensors_of_a_repository(spark, tmp_path, kind):
    from corpusflow.sources import hub

    a = np.arange(12, dtype="<f4")
    if kind == "gguf":
        gguf(tmp_path / f"m.{kind}", [], [("a", (12,), 0, 0)], a.tobytes())
    else:
        safetensors(tmp_path / f"m.{kind}", {"a": a})
    content = (tmp_path / f"m.{kind}").read_bytes()
    get = lambda url: json.dumps({"siblings": [{"rfilename": f"sub/m.{kind}"}, {"rfilename": "config.json"}]}).encode() if "/api/" in url else content if url.endswith(kind) else None
    repo = hub.Repo("a/b", cache_dir=str(tmp_path / "cache"), transport=get)
    rows = tensors.from_repo(spark, repo, kind).collect()
    assert [(r["name"], r["data"]) for r in rows] == [("a", a.tobytes())]
