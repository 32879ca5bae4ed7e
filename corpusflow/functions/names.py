"""Names, paths and prompts, as column expressions and, where a table of rules decides, as plain functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that stay in capitals in generated names (fixed values).
ACRONYMS = ["id", "html", "url", "http", "api", "ascii", "css", "dns", "https", "json", "ip", "uri", "tcp"]


def camel_case(name: Column) -> Column:
    """`query_id` to `QueryID`: parts between underscores, acronyms in capitals, else the first letter only."""
    parts = F.filter(F.split(name, "_"), lambda p: p != "")
    whole = F.array(*(F.lit(a) for a in ACRONYMS))
    first = lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))
    return F.array_join(F.transform(parts, lambda p: F.when(F.array_contains(whole, F.lower(p)), F.upper(p)).otherwise(first(p))), "")


def clean_path(path: Column) -> Column:
    """A relative path without `.`, `..` and empty parts; `..` never leaves the root, and nothing left is `.`."""
    step = lambda kept, part: F.when(part.isin("", "."), kept).when(part == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(part)))
    kept = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.when(F.size(kept) == 0, F.lit(".")).otherwise(F.array_join(kept, "/"))


def legal_file_name(name: Column) -> Column:
    """Neither absolute nor with `..`."""
    return ~name.startswith("/") & ~name.contains("..")


def flat_folder_name(repo_type: Column, repo_id: Column) -> Column:
    """`datasets--owner--name`."""
    return F.concat(repo_type, F.lit("--"), F.replace(repo_id, F.lit("/"), F.lit("--")))


def file_url(endpoint: str, repo_type: str, repo_id: Column, revision: Column, file_name: Column) -> Column:
    """Of a file in a repository (repo_type: models, datasets, spaces); model repositories leave the type out."""
    kind = [] if repo_type == "models" else [F.lit(repo_type)]
    return F.concat_ws("/", F.lit(endpoint.rstrip("/")), *kind, repo_id, F.lit("resolve"), revision, file_name)


def info_url(endpoint: str, repo_type: str, repo_id: Column, revision: Column) -> Column:
    return F.concat_ws("/", F.lit(endpoint.rstrip("/")), F.lit("api"), F.lit(repo_type), repo_id, F.lit("revision"), revision)


def trim_quotes(value: Column) -> Column:
    """An ETag without the quotes around it."""
    return F.regexp_replace(value, '^"+|"+$', "")


def build_prompt(prompts: Column, task: Column, default: Column, text: Column) -> Column:
    """The task's prompt before the text; no task: the default's. A task without a prompt leaves the text as it is."""
    name = F.when(F.coalesce(task, F.lit("")) == "", default).otherwise(task)
    return F.concat(F.coalesce(F.try_element_at(prompts, F.coalesce(name, F.lit(""))), F.lit("")), text)


def instruct_query(instruction: Column, query: Column) -> Column:
    return F.when(F.coalesce(instruction, F.lit("")) == "", query).otherwise(F.concat(F.lit("Instruct: "), instruction, F.lit("\nQuery: "), query))


#: What weights are called in checkpoints, and their scope and variable here. `{n}` is a layer's number. Fixed values.
_ATTENTION = "MultiHeadAttention"
TENSOR_NAMES: list[tuple[str, str, str]] = [
    ("embeddings.word_embeddings.weight", "token_embed", "embeddings"),
    ("embeddings.position_embeddings.weight", "pos_embed", "embeddings"),
    ("embeddings.token_type_embeddings.weight", "token_type_embed", "embeddings"),
    *((f"embeddings.LayerNorm.{a}", "embed_norm/layer_normalization", b) for a, b in (("weight", "gain"), ("bias", "offset"))),
    *((f"encoder.layer.{{n}}.{part}.{a}", f"layer_{{n}}/{to}/dense", b) for part, to in (
        ("attention.self.query", f"attn/{_ATTENTION}/query"), ("attention.self.key", f"attn/{_ATTENTION}/key"), ("attention.self.value", f"attn/{_ATTENTION}/value"),
        ("attention.output.dense", f"attn/{_ATTENTION}/output"), ("intermediate.dense", "ff1"), ("output.dense", "ff2"),
    ) for a, b in (("weight", "weights"), ("bias", "biases"))),
    *((f"encoder.layer.{{n}}.{part}.LayerNorm.{a}", f"layer_{{n}}/{to}/layer_normalization", b) for part, to in (("attention.output", "norm1"), ("output", "norm2")) for a, b in (("weight", "gain"), ("bias", "offset"))),
    ("embed_tokens.weight", "token_embed", "embeddings"),
    ("embed_tokens_per_layer.weight", "token_embed_per_layer", "embeddings"),
    ("per_layer_model_projection.weight", "per_layer_model_projection/dense", "weights"),
    ("per_layer_projection_norm.weight", "per_layer_projection_norm/rms_norm", "scale"),
    ("norm.weight", "final_norm/rms_norm", "scale"),
    *((f"layers.{{n}}.{part}.weight", f"layer_{{n}}/{to}/rms_norm", "scale") for part, to in (
        ("input_layernorm", "input_norm"), ("post_attention_layernorm", "post_attention_norm"), ("pre_feedforward_layernorm", "pre_feedforward_norm"),
        ("post_feedforward_layernorm", "post_feedforward_norm"), ("post_per_layer_input_norm", "post_per_layer_input_norm"),
    )),
    *((f"layers.{{n}}.{part}.weight", f"layer_{{n}}/{part}/dense", "weights") for part in ("per_layer_input_gate", "per_layer_projection")),
    ("layers.{n}.layer_scalar", "layer_{n}", "layer_scalar"),
    *((f"layers.{{n}}.self_attn.{p}_proj.weight", f"layer_{{n}}/self_attn/{_ATTENTION}/{to}/dense", "weights") for p, to in (("q", "query"), ("k", "key"), ("v", "value"), ("o", "output"))),
    *((f"layers.{{n}}.self_attn.{p}_norm.weight", f"layer_{{n}}/self_attn/{_ATTENTION}/{to}/rms_norm", "scale") for p, to in (("q", "query"), ("k", "key"))),
    *((f"layers.{{n}}.mlp.{p}_proj.weight", f"layer_{{n}}/mlp/{p}_proj/dense", "weights") for p in ("gate", "up", "down")),
]


def map_tensor_name(name: Column) -> Column:
    """struct(scope, variable) of a transformer checkpoint's weight; null for one that isn't known."""
    bare = F.regexp_replace(name, r"^((model|language_model)\.)+", "")
    number = F.regexp_extract(bare, r"^(?:encoder\.layer|layers)\.([0-9]+)\.", 1)
    pattern = F.regexp_replace(bare, r"^(encoder\.layer|layers)\.[0-9]+\.", "$1.{n}.")
    rules = F.create_map(*(x for k, scope, variable in TENSOR_NAMES for x in (F.lit(k), F.struct(F.lit(scope).alias("scope"), F.lit(variable).alias("variable")))))
    found = F.try_element_at(rules, pattern)
    return F.when(found.isNotNull(), F.struct(F.replace(found["scope"], F.lit("{n}"), F.regexp_replace(number, "^0+(?=.)", "")).alias("scope"), found["variable"].alias("variable")))


def map_vision_tensor_name(name: Column) -> Column:
    """struct(scope, variable) of a segmentation checkpoint's weight: the scope is the name's path."""
    parts = F.split(name, r"\.")
    leaf, before = F.element_at(parts, -1), F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))
    owner = F.when(before.rlike("^[0-9]") & (F.size(parts) > 2), F.try_element_at(parts, F.lit(-3))).otherwise(before)
    is_norm, is_table = owner.contains("norm"), owner.rlike("(_embed|_token|_tokens)$")
    weight = F.when(is_norm, "gain").when(is_table, "embeddings").otherwise("weights")
    variable = F.when(leaf == "weight", weight).when(leaf == "bias", F.when(is_norm, "offset").otherwise("biases")).otherwise(leaf)
    return F.struct(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/").alias("scope"), variable.alias("variable"))


def align_vision_name(scope: Column, variable: Column, rank: Column) -> Column:
    """Where a vision weight goes: norms to gain and offset, rank 4 to a convolution, rank 2 to a dense layer (transposed), else as it is.

    rank is that of the layer's own `weights`.
    """
    owner = F.element_at(F.split(scope, "/"), -1)
    norm = F.when(variable.isin("gain", "weights"), "gain").when(variable.isin("offset", "biases"), "offset")
    plain = F.concat_ws("/", scope, variable)
    dense = variable.isin("weights", "biases") & ~owner.rlike("(_embed|_token|_tokens)$")
    return (
        F.when(owner.contains("norm"), F.coalesce(F.concat(scope, F.lit("/layer_normalization/"), norm), plain))
        .when(dense & (rank == 4), F.concat_ws("/", scope, F.lit("conv"), variable))
        .when(dense & (rank == 2), F.concat_ws("/", scope, F.lit("dense"), variable))
        .otherwise(plain)
    )


def parse_numbers(text: str, per_item: int) -> list[list[int]]:
    """`1,2;3,4` to lists of per_item numbers (points have 2 or 3, boxes 4)."""
    items = [[int(x) for x in part.split(",")] for part in text.split(";") if part.strip()]
    if wrong := [i for i in items if len(i) != per_item]:
        raise ValueError(f"{per_item} numbers are needed: {wrong[0]}")
    return items


#: Fixed values; anything unknown is grey.
COLORS = {"red": (255, 0, 0), "green": (0, 255, 0), "blue": (0, 0, 255), "yellow": (255, 255, 0), "magenta": (255, 0, 255), "cyan": (0, 255, 255), "gray": (128, 128, 128), "grey": (128, 128, 128)}


def parse_color(text: str) -> tuple[int, int, int]:
    """A name, `#rrggbb` or `r,g,b`."""
    text = text.strip().lower()
    if re.fullmatch("#[0-9a-f]{6}", text):
        return tuple(bytes.fromhex(text[1:]))  # type: ignore[return-value]
    if re.fullmatch(r"\d+, *\d+, *\d+", text):
        return tuple(int(x) & 255 for x in text.split(","))  # type: ignore[return-value]
    return COLORS.get(text, COLORS["gray"])


def indexed_path(path: str, index: int) -> str:
    """`out.png` to `out_2.png`."""
    stem, dot, ending = path.rpartition(".")
    return f"{stem}_{index}.{ending}" if dot else f"{path}_{index}"


def expand_home(path: Column, home: Column) -> Column:
    """`~` and `~/...` below home; other paths, `~name` among them, as they are."""
    return F.when((path == "~") | path.startswith("~/"), F.concat(home, F.substring(path, F.lit(2), F.length(path)))).otherwise(path)
