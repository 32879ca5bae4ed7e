"""Subword tokenizers from tokenizer.json: normalizers, pre-tokenizers, models, post-processors, decoders."""

from .core import Encoding, Options, SpecialToken, Tokenizer, TokenizerConfig, register, tokenizer_for
from .frames import decode_column, encode_column, encode_ids_column, tokens_table, vocabulary_frame

__all__ = ["Encoding", "Options", "SpecialToken", "Tokenizer", "TokenizerConfig", "decode_column", "encode_column", "encode_ids_column", "register", "tokenizer_for", "tokens_table", "vocabulary_frame"]
