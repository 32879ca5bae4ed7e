"""Toxicity, languages, vectors, GIF, BPE, token files and licences: brute force, round trips, held-out accuracy, edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import ann, bpe, gif, langid, licenses, tokenfile, toxicity

public = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def path():
    return public.path("byte_bpe_50k.json")


def texts(spark, rows, extra=False):
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    return df.select("*", *(F.lit(1).alias(n) for n in ("ids", "score", "media", "h", "id", "toxic"))) if extra else df


ODD = [None, "", " ", "\n\n", "a", "é" * 5000, "x" * 30000, "<|endoftext|> a<|endoftext|>", "日本語 text 🙂 z", "the cat sat on the mat " * 3000, "\t\x1c\x85\xa0a", "ﬁne"]

# ---- toxicity


def toxic_corpus(n=400):
    rng = random.Random(3)
    clean = [f"{a}{b}{c}" for a in ("thing", "onwh", "red", "mat", "sat") for b in "aeioubcd" for c in ("ly", "er", "en", "st", "ou")]
    bad = ["scumlike", "scumly", "vileness", "vilely"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        w = rng.choices(clean, k=rng.randint(5, 80)) + ([rng.choice(bad) for _ in range(rng.randint(1, 9))] if toxic else [])
        rng.shuffle(w)
        rows.append(" ".join(w))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_finds_held_out_rows(spark):
    rows, labels = toxic_corpus()
    held = [x for x in labels if x[0] % 4 != 3]
    out = {r["doc_id"]: r for r in toxicity.toxic_severity(texts(spark, rows, extra=True), spark.createDataFrame(held, "doc_id long, toxic int")).collect()}
    assert all(out[i]["toxic"] == bool(t) for i, t in labels)
    assert all(0 <= r["severity"] <= 3 and 0 <= r["grade"] <= 3 for r in out.values())
    many, few = (np.mean([out[i]["severity"] for i, t in labels if t and (sum(x.startswith(("scum", "vile")) for x in rows[i].split()) > 6) == big]) for big in (True, False))
    assert many > few + 0.5
    kept = toxicity.without_toxic(texts(spark, rows, extra=True), spark.createDataFrame(held, "doc_id long, toxic int"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, t in labels if not t] and "media" in kept.columns


def test_toxicity_edges(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.toxic_severity(texts(spark, ODD), none).collect()
    assert len(out) == len(ODD) and not any(r["toxic"] for r in out)
    odd = spark.createDataFrame([(None, 1), (3, None), (4, 7), (4, 0), (4, 1)], "doc_id long, toxic int")
    assert toxicity.toxic_severity(texts(spark, ODD), odd).count() == len(ODD)
    assert toxicity.toxic_severity(texts(spark, ODD).limit(0), odd).count() == 0
    model = toxicity.Model({"a": 0}, np.array([2.0]), np.array([0.0, 1.0, 2.0]))
    above = model.above([toxicity.Counts(model)("A a b"), toxicity.Counts(model)(None)])
    s = 2 * (1 + np.log(2))
    assert np.allclose(above, [[1 / (1 + np.exp(t - s)) for t in (0, 1, 2)], [1 / (1 + np.exp(t)) for t in (0, 1, 2)]])


# ---- languages


def test_one_bar_for_features_of_any_fit():
    """Of 40 toxic and 40 clean rows, 14 and 0 are a z of 2.6, 35 and 2 one of 7."""
    import pandas as pd

    rows = [(f"plain {'weak ' * (i < 14)}{'strong' * (i < 35)}", 1, 1.0) for i in range(40)] + [(f"plain {'strong' * (i < 2)}", 0, 1.0) for i in range(40)]
    model = toxicity.fit_model(pd.DataFrame(rows, columns=["text", "toxic", "weight"]))
    assert "strong" in model.features and "weak" not in model.features


def test_gradients_are_right():
    net = langid.Network.new(["a", "b", "c"])
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, _ = langid.to_array([b" abc", b" zy", b" q"])
    y = np.array([0, 2, 1])
    _, g = net.gradients(x, y)
    rng = np.random.default_rng(1)
    for k, v in net.w.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in v.shape) if k != "E" else (int(rng.choice(x.ravel())), int(rng.integers(0, v.shape[1])))
            old = v[at]
            v[at] = old + 1e-3
            up = net.gradients(x, y)[0]
            v[at] = old - 1e-3
            down = net.gradients(x, y)[0]
            v[at] = old
            assert g[k][at] == pytest.approx((up - down) / 2e-3, abs=2e-3)


def test_languages(spark):
    rng = random.Random(2)
    parts = {"en": ["the", "ing", "tion", "wh"], "de": ["sch", "ung", "ü", "ei"], "fr": ["eau", "é", "que", "oi"]}
    rows = [(i, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(rng.randint(4, 40))), lang) for i, lang in enumerate(rng.choices(list(parts), k=300))]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "123 -- ²½ !", "de"), (1003, "the ingtion whthe", None), (None, "queeau oié oiéque", "fr"), (1004, "x" * 200_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    out = langid.identify(df).collect()
    assert len(out) == len(rows)
    of = {r["doc_id"]: r for r in out}
    assert all(of[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows if i is not None) and of[None]["held_out"] is False
    held = [(of[i]["lang_pred"], lang) for i, _, lang in rows[:300] if of[i]["held_out"]]
    assert len(held) > 40 and np.mean([a == b for a, b in held]) > 0.97
    assert [of[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and of[None]["lang_pred"] == "fr" and of[1004]["lang_pred"] != "und"
    assert all(0 <= r["score"] <= 1 for r in out)
    none = langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in none} == {"und"} and langid.identify(df.limit(0)).count() == 0


def test_every_language_is_learned(spark):
    """However many there are, and however few rows one has beside another."""
    rows = [(i, f"word{chr(97 + i % 26)} text", f"l{i % 69}") for i in range(1000)] + [(5000 + i, "rare words", "zz") for i in range(4)]
    net = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=100)
    assert sorted(net.langs) == sorted({lang for _, _, lang in rows}) and len(net.langs) == 70


def test_pooling_doesnt_depend_on_batches(monkeypatch):
    net, lots = langid.Network.new(["a", "b"]), ["ab cd " * 50, "x" * 100, "cd ab", "é ü ß"]
    whole = langid.Memory(net).batch(lots)
    monkeypatch.setattr(langid, "BLOCK", 16)
    monkeypatch.setattr(langid, "MEMO", 3)
    assert [(a, round(s, 5)) for a, s in langid.Memory(net).batch(lots)] == [(a, round(s, 5)) for a, s in whole]


# ---- nearest neighbours


def brute(ids, x, every=20, k=20):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [int(ids[j]) for j in order]
    return out


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row], "x") for i, row in enumerate(x)], "vec_id long, embedding array<float>, score string")


def test_small_tables_have_lists_too(spark):
    x = np.random.default_rng(1).normal(size=(300, 16)).astype("f4")
    x[50:90] = x[10]
    got: dict = {}
    for r in ann.search(vectors(spark, x)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
        assert r["score"] == pytest.approx(float(x[r["query_id"]].astype("f8") @ x[r["vec_id"]].astype("f8")), abs=1e-9) and r["rank"] == len(got[r["query_id"]])
    want = brute(np.arange(300), x.astype("f8"))
    assert all(v == sorted(v) and len({i for _, i in v}) == 20 for v in got.values()) and got.keys() == want.keys()
    hits = [(i, {b for _, b in got[i]}, x[i].astype("f8") @ x[w[-1]].astype("f8")) for i, w in want.items()]
    # Of the equal vectors any may be listed: what counts is the score of the last.
    assert np.mean([sum(x[i].astype("f8") @ x[j].astype("f8") >= last - 1e-9 for j in found) / 20 for i, found, last in hits]) >= 0.9


def test_lists_reach_their_recall(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(2000, 32)), rng.normal(size=(8, 32)).repeat(250, axis=0) * 3 + rng.normal(size=(2000, 32)) * 0.2]) * rng.uniform(0.5, 2, size=(4000, 1))
    monkeypatch.setattr(ann, "TILE", 300)
    got: dict = {}
    for r in ann.search(vectors(spark, x.astype("f4"))).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute(np.arange(4000), x.astype("f4").astype("f8"))
    assert all(len(v) == 20 for v in got.values())
    assert np.mean([len(got[i] & set(w)) / 20 for i, w in want.items()]) >= 0.9


def test_vectors_that_take_no_part(spark):
    bad = [(20, None), (40, []), (60, [0.0, 0.0]), (80, [float("nan"), 1.0]), (100, [float("inf"), 1.0]), (120, [None, 1.0]), (140, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    good = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (2, [9.0, 9.0]), (160, [0.0, 1.0])]
    df = spark.createDataFrame(bad + good, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in ann.search(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 2, 9.0), (0, 2, 1, 0.5), (0, 3, 2, 0.5), (0, 4, 160, 0.0), (160, 1, 2, 9.0), (160, 2, 1, 0.5), (160, 3, 2, 0.5), (160, 4, 0, 0.0)]
    assert ann.search(df.limit(0)).count() == 0 and ann.search(df.where("vec_id = 0")).count() == 0


# ---- GIF


def test_gif_round_trip(spark):
    stored = gif.stored(texts(spark, ODD, extra=True))
    out = {r["doc_id"]: r for r in gif.digest(stored).collect()}
    media = {r["doc_id"]: bytes(r["media"]) for r in stored.collect()}
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        r = out[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media[i]), hashlib.sha256(media[i]).hexdigest()) and r["feature"].startswith(f"{len(payload) // 576}x24x24@")
    assert out[0]["feature"] == out[1]["feature"] and gif.digest(gif.stored(texts(spark, ODD).limit(0))).count() == 0
    rows = gif.frames(stored.where("doc_id in (4, 5)")).orderBy("doc_id", "frame").collect()
    assert len(rows) == 1 + -(-10000 // 576) and sum(rows[0]["histogram"]) == 576 and rows[2]["start_ms"] == 40
    assert gif.frames(spark.createDataFrame([(1, None), (2, b"GIF89a"), (3, b"no")], "doc_id long, media binary")).count() == 0


@pytest.mark.parametrize("bits", [2, 5, 8])
def test_lzw(bits):
    rng = np.random.default_rng(bits)
    for data in (rng.integers(0, 1 << bits, 70_000), np.zeros(70_000, int), rng.integers(0, 2, 70_000), np.arange(9) % (1 << bits), np.array([1])):
        raw = data.astype(np.uint8).tobytes()
        assert gif.lzw_decode(gif.lzw_pack([gif.lzw_codes(raw, bits)], bits), bits, [len(raw)])[0].tobytes() == raw


def test_broken_streams():
    good = gif.lzw_pack([gif.lzw_codes(b"hello hello")])[0]
    for stream, size in ((good[:3], 11), (good, 12), (b"", 1), (bytes([0, 1 | 6]) + b"\xff" * 8, 5)):
        with pytest.raises(ValueError):
            gif.lzw_decode([stream], 8, [size])
    assert [x.tobytes() for x in gif.lzw_decode([good, good], 8, [11, 5])] == [b"hello hello", b"hello"]


def handmade(images, width=4, height=2, bits=2, table=True):
    """A GIF block by block: (left, top, w, h, indices, delay, disposal, transparent, own palette, interlaced)."""
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    out = b"GIF89a" + bytes([width, 0, height, 0, 0x81 if table else 1, 0, 0]) + (palette if table else b"")
    for left, top, w, h, idx, delay, disposal, transparent, own, woven in images:
        out += b"\x21\xf9\x04" + bytes([disposal << 2 | (transparent >= 0), delay, 0, max(0, transparent)]) + b"\0"
        out += b"\x2c" + bytes([left, 0, top, 0, w, 0, h, 0, (0x81 if own else 0) | (0x40 if woven else 0)]) + (own or b"")
        stream = gif.lzw_pack([gif.lzw_codes(bytes(idx), bits)], bits)[0]
        out += bytes([bits, len(stream)]) + stream + b"\0"
    return out + b";"


def test_disposal_transparency_palettes_and_interlacing():
    red, green, blue, none = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255), (0, 0, 0, 0)
    own = bytes([9, 9, 9] * 4)
    g = handmade([
        (0, 0, 4, 2, [1] * 8, 5, 1, -1, None, False), (1, 0, 2, 1, [2, 2], 5, 3, -1, None, False), (0, 1, 2, 1, [3, 0], 5, 2, 0, None, False), (3, 1, 1, 1, [1], 7, 0, -1, own, False),
    ])
    width, height, images = gif.read_gifs([g])[0]
    shown = [([tuple(map(tuple, row)) for row in f.tolist()], ms) for f, ms in gif.compose(width, height, images)]
    assert shown[0] == ([(red,) * 4, (red,) * 4], 50)
    assert shown[1] == ([(red, green, green, red), (red,) * 4], 50)
    assert shown[2] == ([(red,) * 4, (blue, red, red, red)], 50)  # the second was put back, index 0 lets red through
    assert shown[3] == ([(red,) * 4, (none, none, red, (9, 9, 9, 255))], 70)  # the third's area was cleared
    rows = list(range(4)) * 2 + [1]
    woven = [rows[r] % 4 for r in (0, 8, 4, 2, 6, 1, 3, 5, 7)]
    _, _, images = gif.read_gifs([handmade([(0, 0, 1, 9, woven, 0, 0, -1, None, True)], 1, 9)])[0]
    assert images[0].indices[:, 0].tolist() == [rows[r] % 4 for r in range(9)]


def test_only_value_errors_leave_the_reader(spark):
    """Of bytes changed at random, cut short, or with impossible code sizes and screens."""
    rng, good = random.Random(5), handmade([(0, 0, 4, 2, [1] * 8, 5, 1, -1, None, False), (1, 0, 2, 1, [2, 2], 5, 3, -1, None, True)])
    files = [good[: rng.randrange(len(good))] for _ in range(60)]
    for _ in range(1500):
        b = bytearray(good)
        for _ in range(rng.randint(1, 4)):
            b[rng.randrange(6, len(b))] = rng.choice([0, 1, 2, 64, 128, 255, rng.randrange(256)])
        files.append(bytes(b))
    at = good.index(b"\x2c") + 10
    files += [good[:at] + bytes([n]) + good[at + 1 :] for n in (0, 1, 9, 12, 64, 128, 255)] + [good[:6] + b"\xff" * 4 + good[10:]]
    bad = 0
    for f in files:
        try:
            width, height, images = gif.read_gifs([f])[0]
        except ValueError:
            bad += 1
            continue
        if width * height < 1 << 16:
            assert all(x.shape == (height, width, 4) for x, _ in gif.compose(width, height, images))
    assert bad > 300
    media = spark.createDataFrame([(0, 1, good), (1, 1, files[-1]), (2, 1, None), (3, 1, good)], "doc_id long, n_bytes long, media binary")
    assert sorted((r["doc_id"], r["payload_bytes"] is None) for r in gif.digest(media).collect()) == [(0, False), (1, True), (2, True), (3, False)]
    assert gif.frames(media).count() == 4


def test_feature_is_what_the_frames_show(spark):
    """The feature's histogram is counted over frames decoded on their own."""
    out = {r["doc_id"]: r["feature"] for r in gif.stored_digest(texts(spark, ODD)).collect()}
    sums: dict = {}
    for r in gif.frames(gif.stored(texts(spark, ODD))).collect():
        old = sums.setdefault(r["doc_id"], [0, 0, [0] * 64])
        sums[r["doc_id"]] = [old[0] + 1, old[1] + r["delay_ms"], [a + b for a, b in zip(old[2], r["histogram"], strict=True)]]
    assert out == {i: f"{n}x24x24@{ms}ms:{','.join(map(str, h))}" for i, (n, ms, h) in sums.items()}


# ---- BPE and token files


def test_same_ids_and_text_as_the_library(spark, path):
    from tokenizers import Tokenizer

    rng = random.Random(8)
    alphabet = "abcdefghijklmnopqrstuvwxyzABC  '\n\t.,!?0123456789éüßñ日本語🙂　\x1c\x85\xa0²ªµ"
    rows = ODD + ["".join(rng.choices(alphabet, k=rng.randint(0, 150))) for _ in range(1500)] + [" ".join(rng.choices(["the", "ing", "don't", "we'll", "nation", "er"], k=40)) for _ in range(200)]
    theirs = Tokenizer.from_file(path)
    want = [theirs.encode(t or "", add_special_tokens=False).ids for t in rows]
    got = {r["doc_id"]: r for r in bpe.encode_documents(texts(spark, rows, extra=True), path).collect()}
    for i, ids in enumerate(want):
        text = theirs.decode(ids, skip_special_tokens=False)
        r = got[i]
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    back = bpe.decode_documents(bpe.encode_documents(texts(spark, rows), path), path)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: t or "" for i, t in enumerate(rows)}
    assert bpe.encode_documents(texts(spark, rows).limit(0), path).count() == 0
    v = bpe.vocabulary(path)
    part = want[-1][1:40]
    assert v.decode(np.array([*part, 10**6, -1])) == theirs.decode(part) and v.decode(np.array([447])) == theirs.decode([447])


def test_speculation_is_exact_and_verifies(path):
    v = bpe.vocabulary(path)
    words, rng = bpe.SpeculativeWords(v), random.Random(1)
    some = [" " + "".join(rng.choices("thenrstioa", k=rng.randint(1, 14))) for _ in range(3000)] + ["q" * 100]
    flat, lengths = words(some)
    at = np.concatenate([[0], np.cumsum(lengths)])
    assert all(flat[a:b].tolist() == v.merge(w.encode()) for w, a, b in zip(some, at, at[1:], strict=False))
    assert 0 < words.failed < words.words
    w = "abcd" * 300
    assert v._merge_few([v.single[b] for b in w.encode()]) == v._merge_many([v.single[b] for b in w.encode()], len(w))


def test_other_tokenizers_are_refused(path, tmp_path):
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    small = spec | {"model": spec["model"] | {"merges": []}}
    for change in ({"model": small["model"] | {"dropout": 0.1}}, {"model": small["model"] | {"ignore_merges": True}}, {"added_tokens": [t | {"lstrip": True} for t in spec["added_tokens"]]}, {"pre_tokenizer": spec["pre_tokenizer"] | {"use_regex": False}}):
        (tmp_path / "t.json").write_text(json.dumps(small | change))
        with pytest.raises(ValueError):
            bpe.Vocabulary(str(tmp_path / "t.json"))


def test_memory_of_words_is_bounded(path, monkeypatch):
    e = bpe.TextEncoder(bpe.vocabulary(path), bpe.SpeculativeWords(bpe.vocabulary(path)), 50)
    monkeypatch.setattr(bpe, "BLOCK", 200)
    monkeypatch.setattr(bpe, "PIECE", 7)
    long = " ".join(f"w{i}x" for i in range(400))
    got = e.encode([long, "a b", long])
    plain = bpe.speculative(path).encode([long, "a b"])
    assert [x.tolist() for x in got] == [plain[0].tolist(), plain[1].tolist(), plain[0].tolist()] and len(e.memo) <= 50


def test_token_files(spark, path, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    rows = ODD + [" ".join(rng.choices(["the", "red", "nation", "qqzz"], k=rng.randint(0, 300))) for _ in range(300)]
    df = texts(spark, rows, extra=True).repartition(5)
    files = tokenfile.write(df, path, str(tmp_path), sequence=64)
    got = sorted(tuple(r) for r in tokenfile.read(spark, str(tmp_path), files).collect())
    theirs, start, want = Tokenizer.from_file(path), 0, []
    for i, t in enumerate(rows):
        ids = [*theirs.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    filesystem, _ = tokenfile.open_folder(str(tmp_path))
    reader = tokenfile.Reader(filesystem, files[0][1])
    assert reader.file.schema.field("ids").type == pa.list_(pa.uint16(), 64) and reader.sequence_of(0).base is not None
    total = files[0][3]
    last = (total - 1) // 64
    mask, bits = reader.mask_of(last), reader.mask_bits(last)
    assert mask.to_pylist() == [i < total - 64 * last for i in range(64)] == np.unpackbits(bits, bitorder="little").astype(bool).tolist()
    assert not bits.flags.owndata and np.unpackbits(reader.mask_bits(0)).all() == (total >= 64)
    assert np.array_equal(reader.ids(64 * last, 3)[: total - 64 * last], reader.sequence_of(last)[: min(3, total - 64 * last)])
    reader.close()
    assert not list(tmp_path.glob("*.draft"))
    assert tokenfile.token_files(df.limit(0), path).count() == 0
    twice = spark.createDataFrame([(None, "b"), (7, "a"), (7, "a"), (None, None)], "doc_id long, text string")
    assert tokenfile.token_files(twice, path).groupBy("n_tokens").count().count() == 2


# ---- licences


def test_licenses(spark):
    prose = [" ".join(random.Random(i).choices(["thing", "there", "onwh", "red", "sat", "mat", "license", "public", "of", "the", "under"], k=20)) for i in range(150)]
    plain = [*prose, *licenses.OTHERS]
    told = [("MIT", "Released under the MIT License."), ("Apache", "x y\nLicensed under the Apache License, Version 2.0.\nmore"), ("GPL", "This work is licensed under the GNU General Public License, version 3."), ("CC-BY-NC", "Licensed under CC BY-NC 4.0."), ("MIT", licenses.TEMPLATES["MIT"][0].upper()), ("BSD", "thing " + licenses.TEMPLATES["BSD"][0] + " there")]
    df = texts(spark, plain + [t for _, t in told] + ODD, extra=True)
    out = {r["doc_id"]: r for r in licenses.licenses(df).collect()}
    n = len(plain)
    assert [out[n + i]["families"] for i in range(len(told))] == [f for f, _ in told]
    assert all(out[i]["licence_paragraphs"] == 0 for i in range(n)) and sum(out[i]["unknown_paragraphs"] for i in range(n)) <= 3
    odd = [out[n + len(told) + i] for i in range(len(ODD))]
    assert all(r["families"] == "" for r in odd) and odd[0]["paragraphs"] == 0 and odd[0]["score"] == 0.0
    assert out[n + 1]["paragraphs"] == 2 and licenses.licenses(df.limit(0)).count() == 0
    mixed = "Licensed under CC BY-NC 4.0.\n" * 2 + "Released under the MIT License."
    row = licenses.scan(texts(spark, [mixed]), licenses.fit_model(prose)).first()
    assert (row["licence_paragraphs"], row["families"]) == (3, "CC-BY-NC,MIT")
