"""Tokenizers against fixed values, invariants and the tokenizers library where both agree."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corpusflow.operators.tokenizer import Options, SpecialToken, Tokenizer, TokenizerConfig, decode_column, encode_column, encode_ids_column, tokens_table, vocabulary_frame
from corpusflow.operators.tokenizer.text import Aligned, normalizer, pre_tokenizer

#: Words of a river walk; ids by their order.
SPECIAL = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"]
RIVER = [*SPECIAL, "river", "stone", "walk", "bank", "##s", "##ed", "##ing", "along", "an", "old", "we", "office", "##side", "fjord"]
AT = {t: i for i, t in enumerate(RIVER)}
WORDPIECE = {
    "added_tokens": [{"id": AT[t], "content": t, "special": True, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False} for t in SPECIAL],
    "normalizer": {"type": "BertNormalizer", "lowercase": True, "clean_text": True, "handle_chinese_chars": True, "strip_accents": None}, "pre_tokenizer": {"type": "BertPreTokenizer"},
    "decoder": {"type": "WordPiece", "prefix": "##", "cleanup": False}, "post_processor": None,
    "model": {"type": "WordPiece", "unk_token": "[UNK]", "continuing_subword_prefix": "##", "max_input_chars_per_word": 100, "vocab": AT},
}
MERGES = ["n e", "s t", "o ne", "st one", "r i", "v e", "ri ve", "rive r"]
LETTERS = ["<unk>", *"abeinorstv", *(m.replace(" ", "") for m in MERGES)]
BPE = {
    "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "decoder": {"type": "BPEDecoder", "suffix": ""}, "post_processor": None,
    "model": {"type": "BPE", "unk_token": "<unk>", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": {t: i for i, t in enumerate(LETTERS)}, "merges": MERGES},
}
MARK = {"type": "Metaspace", "replacement": "▁", "prepend_scheme": "always", "split": True}
PIECES = ["<unk>", "▁", "▁river", "▁stone", "▁by", "stone", "river", "s", "▁walk", "ed"]
UNIGRAM = {
    "added_tokens": [], "normalizer": None, "pre_tokenizer": MARK, "decoder": MARK, "post_processor": None,
    "model": {"type": "Unigram", "unk_id": 0, "byte_fallback": False, "vocab": [[p, -1.0 - 0.001 * i] for i, p in enumerate(PIECES)]},
}


def at(*tokens: str) -> list[int]:
    return [AT[t] for t in tokens]


PLAIN = Options(add_special_tokens=False)


def library_of(spec: dict):
    return pytest.importorskip("tokenizers").Tokenizer.from_str(json.dumps({"version": "1.0", "truncation": None, "padding": None, **spec}))


@pytest.mark.parametrize(("spec", "texts"), [
    (WORDPIECE, ["river stone", "walking", "we walked along an old river", "River STONES", "xyz", "", "an old bank, riverside!", "FJÖRD fjörd"]),
    (BPE, ["river stone", "stones", "rive", "one river", "zz", "", "tone vest " * 30, "riverstone" * 20]),
    (UNIGRAM, ["river stone", "river stones", "walked by stone", "q river", "riverstone"]),
])
def test_ids_are_the_library_s(spec, texts):
    theirs, ours = library_of(spec), Tokenizer(spec)
    assert [ours.encode(t) for t in texts] == [theirs.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids():
    assert Tokenizer(WORDPIECE).encode("walking") == at("walk", "##ing") and Tokenizer(WORDPIECE).encode("xyz") == at("[UNK]") and Tokenizer(WORDPIECE).encode("") == []
    listed = BPE | {"model": BPE["model"] | {"merges": [m.split(" ") for m in MERGES]}}
    assert Tokenizer(listed).encode("river stone") == Tokenizer(BPE).encode("river stone") == [LETTERS.index("river"), LETTERS.index("stone")]
    assert Tokenizer(UNIGRAM).encode("q") == [PIECES.index("▁"), 0]


def test_long_words_merge_alike(monkeypatch):
    from corpusflow.operators.tokenizer import models

    rng = random.Random(2)
    spec = BPE["model"]
    merges = [tuple(m.split(" ")) for m in MERGES] + [("a", "a"), ("aa", "a"), ("a", "b"), ("aa", "aa")]
    run = models.bpe(spec["vocab"] | {"aa": 90, "aaa": 91, "ab": 92, "aaaa": 93}, merges, 0)
    for _ in range(300):
        word = "".join(rng.choices("abrivestone", weights=[8, 3, *[1] * 9], k=rng.randint(1, 90)))
        monkeypatch.setattr(models, "LONG", 10**9)
        want = run(word)
        monkeypatch.setattr(models, "LONG", 0)
        assert run(word) == want
    monkeypatch.setattr(models, "LONG", 64)
    assert len(run("river" * 40_000)) == 40_000


def test_spans_are_bytes_of_the_original():
    t = Tokenizer(WORDPIECE, options=Options(include_spans=True))
    assert t.annotate("we walked along").spans == [(0, 2), (3, 7), (7, 9), (10, 15)]
    assert t.annotate("walking").spans == [(0, 4), (4, 7)]
    assert t.annotate("é river").spans == [(0, 2), (3, 8)]
    assert t.annotate("fjörd river").spans == [(0, 6), (7, 12)]
    led = Tokenizer({"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}, "model": {"type": "BPE", "vocab": {"Ġold": 3, "Ġriver": 4}, "merges": []}}, options=Options(include_spans=True))
    assert [w.text for w in led._cut(Aligned.of("old river"))] == ["Ġold", "Ġriver"]
    assert [w.span(0, len(w.text)) for w in led._cut(Aligned.of("old river"))] == [(0, 3), (3, 9)]


def test_template_bert_and_config():
    cls, sep, walk, ing = at("[CLS]", "[SEP]", "walk", "##ing")
    single = [{"SpecialToken": {"id": "[CLS]", "type_id": 0}}, {"Sequence": {"id": "A", "type_id": 0}}, {"SpecialToken": {"id": "[SEP]", "type_id": 0}}]
    spec = WORDPIECE | {"post_processor": {"type": "TemplateProcessing", "single": single, "pair": single, "special_tokens": {t: {"id": t, "ids": at(t), "tokens": [t]} for t in ("[CLS]", "[SEP]")}}}
    t = Tokenizer(spec, options=Options(include_spans=True, include_special_tokens_mask=True))
    e = t.annotate("walking")
    assert (e.ids, e.special_tokens_mask, e.spans) == ([cls, walk, ing, sep], [1, 0, 0, 1], [(-1, -1), (0, 4), (4, 7), (-1, -1)])
    assert e.ids == library_of(spec).encode("walking").ids
    assert t.encode("") == [cls, sep] and Tokenizer(spec, options=PLAIN).encode("walk") == [walk]
    assert Tokenizer(spec, options=Options(max_len=3)).encode("walking") == [cls, walk, ing]
    bert = Tokenizer(WORDPIECE | {"post_processor": {"type": "BertProcessing", "cls": ["[CLS]", cls], "sep": ["[SEP]", sep]}})
    assert bert.encode("walk") == [cls, walk, sep]
    config = TokenizerConfig.parse('{"bos_token": "[CLS]", "eos_token": {"content": "[SEP]"}, "add_bos_token": true, "add_eos_token": true, "x": 1}')
    assert config.extra == {"x": 1}
    again = Tokenizer(bert.spec, config)
    assert again.encode("walk") == [cls, walk, sep] and Tokenizer(WORDPIECE, config).encode("walk") == [cls, walk, sep]
    assert again.special_token_id(SpecialToken.BEGINNING_OF_SENTENCE) == cls and again.special_token_id(SpecialToken.PAD) == 0
    assert SpecialToken.parse("MASK") is SpecialToken.MASK
    with pytest.raises(ValueError):
        SpecialToken.parse("none")
    with pytest.raises(KeyError):
        Tokenizer(BPE).special_token_id(SpecialToken.MASK)


def test_added_tokens_cut_the_text():
    marks = ["<|open|>", "<|close|>", "<|ask|>"]
    vocab = {t: i for i, t in enumerate(["<unk>", *marks, "who", "walks", "here"])}
    added = [{"id": vocab[t], "content": t, "special": True, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False} for t in marks]
    spec = {"added_tokens": added, "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "decoder": None, "model": {"type": "WordPiece", "unk_token": "<unk>", "continuing_subword_prefix": "##", "max_input_chars_per_word": 100, "vocab": vocab}}
    t, theirs = Tokenizer(spec), library_of(spec)
    for text in ("<|open|><|ask|>who\nwalks here<|close|>\n<|open|>", "who<|close|>walks", "<|ask|", ""):
        assert t.encode(text) == theirs.encode(text).ids
    assert t.vocab_size == 10 and t.distinct_tokens == 7 and t.token_to_id("who") == 4 and t.id_to_token(99) is None


@pytest.mark.parametrize(("spec", "ids", "text"), [
    (WORDPIECE, at("river", "stone"), "river stone"), (WORDPIECE, at("walk", "##ing"), "walking"), (WORDPIECE, [AT["old"], 999, AT["bank"]], "old bank"), (BPE, [LETTERS.index("river"), LETTERS.index("stone")], "riverstone"),
    (BPE | {"decoder": None}, [LETTERS.index("river"), LETTERS.index("stone")], "river stone"), (UNIGRAM, [2, 3], "river stone"),
    (BPE | {"decoder": {"type": "Sequence", "decoders": [{"type": "Replace", "pattern": {"String": "e"}, "content": "E"}, {"type": "Strip", "content": "r"}]}}, [LETTERS.index("river"), LETTERS.index("stone")], "ivEstonE"),
    ({"model": {"type": "BPE", "vocab": {"<0xC3>": 0, "<0xB6>": 1, "▁a": 2}, "merges": []}, "decoder": {"type": "Sequence", "decoders": [{"type": "ByteFallback"}, {"type": "Metaspace", "prepend_scheme": "always"}]}}, [2, 0, 1], "aö"),
])
def test_decode(spec, ids, text):
    assert Tokenizer(spec).decode(ids) == text


def test_normalizers():
    run = lambda spec, text: normalizer(spec)(Aligned(text)).text
    assert run({"type": "NFKC"}, "ﬁ") == "fi"
    assert Tokenizer(WORDPIECE | {"normalizer": {"type": "Sequence", "normalizers": [{"type": "NFKC"}, {"type": "Lowercase"}]}}).encode("oﬀice") == at("office")
    assert run({"type": "NFC"}, "fjo\u0308rd") == "fj\u00f6rd" and run({"type": "StripAccents"}, "fj\u00f6rd") == "fjord"
    assert run({"type": "Replace", "pattern": {"Regex": "(o+)k"}, "content": "<$1>"}, "brook") == "br<oo>"
    assert run({"type": "Prepend", "prepend": "x"}, "a") == "a" and run(None, "A") == "A"
    assert Tokenizer(WORDPIECE).encode("FJÖRD") == at("fjord") == Tokenizer(WORDPIECE).encode("FJO\u0308RD")
    assert Tokenizer(WORDPIECE).normalize("a\tb\n c\0") == "a b  c"
    assert Tokenizer(WORDPIECE).normalize("中a") == " 中 a"


@pytest.mark.parametrize(("behavior", "words"), [
    ("Removed", ["a", "b", "c"]), ("Isolated", ["a", "-", "b", "-", "-", "c"]), ("Contiguous", ["a", "-", "b", "--", "c"]), ("MergedWithPrevious", ["a-", "b-", "-", "c"]), ("merged_with_next", ["a", "-b", "-", "-c"]), ("odd", ["a", "b", "c"]),
])
def test_split_behaviors(behavior, words):
    assert [w.text for w in pre_tokenizer({"type": "Split", "pattern": {"String": "-"}, "behavior": behavior})(Aligned("a-b--c"))] == words


def test_pre_tokenizers():
    run = lambda spec, text: [w.text for w in pre_tokenizer(spec)(Aligned(text))]
    assert run({"type": "Whitespace"}, "a　b c!\u0085d") == ["a", "b", "c!", "d"]
    assert run({"type": "BertPreTokenizer"}, "don't $5.") == ["don", "'", "t", "$", "5", "."]
    assert run({"type": "Punctuation"}, "a b, c") == ["a b", ",", " c"]
    assert run({"type": "ByteLevel"}, "a b\né") == ["a", "ĠbĊÃ©"]
    assert run({"type": "Metaspace", "prepend_scheme": "first"}, "a b") == ["a", "▁b"]
    assert run({"type": "Metaspace", "add_prefix_space": True, "split": False}, "a b") == ["▁a▁b"]
    assert run({"type": "Sequence", "pretokenizers": [{"type": "Whitespace"}, {"type": "Punctuation"}]}, "a, b") == ["a", ",", "b"]
    assert run({"type": "Split", "pattern": {"Regex": "(("}, "behavior": "Isolated"}, "a b") == ["a b"]
    assert [w.text for w in pre_tokenizer({"type": "Split", "pattern": {"String": "-"}, "behavior": "MergedWithNext"}, strict=True)(Aligned("a-b"))] == ["a", "b"]


def test_same_as_the_library():
    library = pytest.importorskip("tokenizers")
    from corpusflow.plans import fixtures

    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz  ", k=60)) for _ in range(300)] + ["the then thing nation", ""]
    spec = fixtures.bpe_spec() | {"version": "1.0", "truncation": None, "padding": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None}
    theirs, ours = library.Tokenizer.from_str(json.dumps(spec)), Tokenizer(fixtures.bpe_spec())
    assert [theirs.encode(t).ids for t in texts] == [ours.encode(t) for t in texts]


def test_columns(spark):
    t = Tokenizer(WORDPIECE, options=Options(include_spans=True))
    df = spark.createDataFrame([(1, "we old walking"), (2, ""), (3, None)], "id int, text string")
    want = at("we", "old", "walk", "##ing")
    assert [r["ids"] for r in df.select("id", encode_ids_column(t, F.col("text")).alias("ids")).orderBy("id").collect()] == [want, [], None]
    rows = {r["id"]: r["e"] for r in df.select("id", encode_column(t, F.col("text")).alias("e")).collect()}
    assert [tuple(s) for s in rows[1]["spans"]] == [(0, 2), (3, 6), (7, 11), (11, 14)] and rows[1]["special_tokens_mask"] is None
    assert df.select("id", decode_column(t, encode_ids_column(t, F.col("text"))).alias("d")).orderBy("id").collect()[0]["d"] == "we old walking"
    assert tokens_table(df, t, "id", "text").count() == 4
    assert vocabulary_frame(spark, t).where("is_special").count() == 5


def test_sentence_piece():
    pytest.importorskip("sentencepiece")
    public = pytest.importorskip("public_tokenizers")
    from corpusflow.operators.tokenizer.core import SentencePiece

    t = SentencePiece(public.path("piece_bpe_32k.model"), options=Options(include_spans=True))
    e = t.annotate("old  river, fjörd")
    assert t.decode(e.ids) == "old  river, fjörd" and e.ids == t.encode("old  river, fjörd")
    assert all(0 <= a <= b <= len("old  river, fjörd".encode()) for a, b in e.spans)
    with pytest.raises(ValueError):
        t.with_options(Options(max_len=3))


@pytest.mark.parametrize("invert", [False, True])
@pytest.mark.parametrize("behavior", ["removed", "isolated", "contiguous", "MergedWithPrevious", "merged_with_next"])
def test_split_columns_are_split_functions(spark, behavior, invert):
    from corpusflow.functions.words import split_words

    texts = ["a-b--c", "--a-", "", "abc", "---", "é-\n-ü", "-a--b-"]
    run = pre_tokenizer({"type": "Split", "pattern": {"Regex": "-"}, "behavior": behavior, "invert": invert})
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", split_words(F.col("t"), "-", behavior, invert=invert).alias("w"))
    assert [r["w"] for r in df.orderBy("i").collect()] == [[w.text for w in run(Aligned(t))] for t in texts]
