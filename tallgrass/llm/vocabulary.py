"""Pieces of a public vocabulary file, read on the driver."""

from __future__ import annotations

from functools import lru_cache

SENTENCE_FILE = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"


@lru_cache(maxsize=2)
def sentence_pieces(path: str = SENTENCE_FILE) -> tuple[tuple[str, ...], int]:
    """(pieces in rank order, number of byte pieces); control pieces and byte
    pieces aren't among the former."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found, n_bytes = [], 0
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            n_bytes += 1
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            found.append(model.id_to_piece(i))
    return tuple(dict.fromkeys(found)), n_bytes
