"""The pieces of a public SentencePiece vocabulary, from its file."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: What stands for a space in a piece.
SPACE = "▁"


@dataclass(frozen=True)
class Vocabulary:
    """Ordinary pieces with their ids and scores, byte pieces' ids by byte, and the unknown's id."""

    pieces: tuple[str, ...]
    ids: tuple[int, ...]
    scores: tuple[float, ...]
    bytes: tuple[int, ...]
    unknown: int


@lru_cache(maxsize=2)
def vocabulary(path: str = VOCABULARY) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary, by_byte = [], {}
    for n in range(model.vocab_size()):
        piece = model.id_to_piece(n)
        if model.is_byte(n):
            by_byte[int(piece[3:5], 16)] = n
        elif not (model.is_control(n) or model.is_unknown(n) or model.is_unused(n)):
            ordinary.append((piece, n, model.get_score(n)))
    pieces, ids, scores = zip(*ordinary)
    return Vocabulary(
        pieces, ids, scores, tuple(by_byte[b] for b in sorted(by_byte)), model.unk_id()
    )
