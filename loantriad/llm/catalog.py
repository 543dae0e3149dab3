"""Loads every module that registers a corpus query."""

from importlib import import_module

from loantriad.llm.registry import CORPUS_CHECKS, CORPUS_QUERIES

MODULES = ("toxicity", "token_files", "passages", "quality", "bpe", "token_counts", "packing", "neardup", "topk", "pages",
           "runs", "alignment", "language")

for _module in MODULES:
    import_module(f"loantriad.llm.{_module}")

__all__ = ["CORPUS_CHECKS", "CORPUS_QUERIES"]
