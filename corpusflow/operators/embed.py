"""Sentence embedding: tokenize, bucket, an injected encoder, pooling, normalization.

The network itself is given as a callable from a matrix of ids to hidden states, (rows, length) to (rows, length, width).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shapes import ShapeFn, by_two_bit_budget
from . import bucket
from .tokenizer import encode_ids_column

Encoder = Callable[[np.ndarray], np.ndarray]


@dataclass
class Pooling:
    """Which states of a sentence are pooled: last before mean before first. No mode, or maximum alone, is an error."""

    last: bool = False
    mean: bool = False
    first: bool = False
    maximum: bool = False

    @classmethod
    def parse(cls, content: str) -> Pooling:
        spec = json.loads(content)
        return cls(*(bool(spec.get(f"pooling_mode_{k}")) for k in ("lasttoken", "mean_tokens", "cls_token", "max_tokens")))

    def __call__(self, hidden: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
        rows, wide = hidden.shape[:2]
        lengths = np.full(rows, wide) if lengths is None else np.asarray(lengths)
        if self.last:
            return hidden[np.arange(rows), np.maximum(lengths - 1, 0)]
        if self.mean:
            on = (np.arange(wide)[None, :] < lengths[:, None]).astype(hidden.dtype)
            return (hidden * on[:, :, None]).sum(1) / np.maximum(lengths, 1)[:, None]
        if self.first:
            return hidden[:, 0]
        raise ValueError("max pooling isn't supported" if self.maximum else "no pooling mode is on")


def normalized(vectors: np.ndarray, least: float = 1e-12) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=-1, keepdims=True), least)


@dataclass
class SentenceModel:
    """Modules in order, as modules.json lists them; types other than Transformer, Pooling and Normalize are left out."""

    modules: list[str] = field(default_factory=lambda: ["Transformer", "Pooling", "Normalize"])
    pooling: Pooling = field(default_factory=lambda: Pooling(mean=True))
    prompts: dict[str, str] = field(default_factory=dict)
    default_prompt: str = ""

    @classmethod
    def parse(cls, modules: str | None, pooling: str | None, sentence: str | None) -> SentenceModel:
        spec = json.loads(sentence or "{}")
        kinds = [m.get("type", "").rpartition(".")[2] for m in json.loads(modules or "[]")]
        made = cls(prompts=spec.get("prompts") or {}, default_prompt=spec.get("default_prompt_name") or "")
        made.modules = [k for k in kinds if k in ("Transformer", "Pooling", "Normalize")] or made.modules
        made.pooling = Pooling.parse(pooling) if pooling else made.pooling
        return made

    def prompt(self, text: str, task: str = "") -> str:
        return self.prompts.get(task or self.default_prompt, "") + text

    def tasks(self) -> list[str]:
        return sorted(self.prompts)

    def __call__(self, ids: np.ndarray, encoder: Encoder, pad: int) -> np.ndarray:
        lengths, out = (ids != pad).sum(1), ids
        for kind in self.modules:
            out = encoder(out) if kind == "Transformer" else self.pooling(out, lengths) if kind == "Pooling" else normalized(out)
        return out


def embed(df: DataFrame, key: str, text: str, tokenizer, encoder: Encoder, model: SentenceModel | None = None, pad: int = 0, shape: ShapeFn | None = None, run: int | None = bucket.RUN) -> DataFrame:
    """(reference, embedding) of each row with a text that isn't empty: one call of the encoder for each padded batch."""
    model, spark = model or SentenceModel(), SparkSession.getActiveSession()
    texts = df.where(F.coalesce(F.col(text), F.lit("")) != "").select(F.col(key).alias("__key"), encode_ids_column(tokenizer, F.col(text)).alias("__ids"))
    batched = bucket.batches(texts, "__key", "__ids", "__key", pad, shape or by_two_bit_budget(8192, 16), batch_padding=True, run=run)
    shared = spark.sparkContext.broadcast((model, encoder))

    def run_batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, encoder = shared.value
        for frame in frames:
            for size, batch, references in zip(frame["seq_len"], frame["batch"], frame["references"], strict=True):
                vectors = model(np.asarray(batch, np.int64).reshape(-1, size), encoder, pad)
                real = [i for i, r in enumerate(references) if r is not None and r == r]
                yield pd.DataFrame({"reference": [references[i] for i in real], "embedding": [vectors[i].astype(float).tolist() for i in real]})

    kind = df.schema[key].dataType.simpleString()
    return batched.select("seq_len", "batch", "references").mapInPandas(run_batches, f"reference {kind}, embedding array<double>")
