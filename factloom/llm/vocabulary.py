"""A SentencePiece vocabulary file, as the pieces and scores that segmentation needs."""

from __future__ import annotations

import os
from typing import NamedTuple

#: The public vocabulary; tests and callers may name another file.
MODEL = os.environ.get("FACTLOOM_SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"


class Vocabulary(NamedTuple):
    ids: dict[str, int]  #: ordinary pieces
    scores: list[float]
    surface: list[bytes]  #: what each id stands for in decoded text, marks as spaces; control pieces as nothing
    byte_ids: list[int]  #: ids of the 256 byte pieces
    unknown: float  #: score of a character that no piece has, the smallest one less 10


def load(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, scores, surface, byte_ids = {}, [], [], [0] * 256
    for i in range(p.get_piece_size()):
        piece, what = p.id_to_piece(i), b""
        scores.append(p.get_score(i))
        if p.is_byte(i):
            b = int(piece[3:5], 16)
            byte_ids[b], what = i, bytes([b])
        elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)):
            ids[piece], what = i, piece.replace(MARK, " ").encode()
        surface.append(what)
    return Vocabulary(ids, scores, surface, byte_ids, min(scores[i] for i in ids.values()) - 10)
