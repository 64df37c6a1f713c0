"""Where the public tokenizers' files are."""

from __future__ import annotations

BYTE_BPE = "byte_bpe_50k.json"


def vocabulary_path(name: str) -> str:
    """The path of a vocabulary file of the installed package; operators take any path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)
