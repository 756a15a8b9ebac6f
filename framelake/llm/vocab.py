"""Public vocabularies, read from files whose paths are parameters; one copy in each Python worker."""

from __future__ import annotations

import base64
import os
from functools import lru_cache
from importlib.util import find_spec


def default_path(name: str) -> str:
    """The file in the installed package of public tokenizers."""
    spec = find_spec("public_tokenizers")
    if spec is None:
        raise FileNotFoundError(f"give the path of {name}; no package of public tokenizers is installed")
    return os.path.join(os.path.dirname(spec.origin), name)


@lru_cache(maxsize=2)
def rank_encoding(path: str):
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def pieces(path: str) -> tuple[list[str], list[float], list[bool]]:
    """Piece strings, scores, and which of them stand for a byte, by id."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(m.get_piece_size())
    return [m.id_to_piece(i) for i in ids], [m.get_score(i) for i in ids], [m.is_byte(i) for i in ids]
