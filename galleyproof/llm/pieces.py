"""Piece vocabularies, and texts as stretches that no piece crosses."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from galleyproof.llm import common as C

SPACE, GAP = "▁", " "
MARK = SPACE.encode()


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces and scores of a model file whose text pieces hold the space mark at their start only, with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.byte_ids = np.zeros(256, np.int64)
        self.pieces: dict[str, int] = {}
        self.output: list[bytes] = []
        self.scores = np.zeros(n)
        for i in range(n):
            piece = model.id_to_piece(i)
            self.scores[i] = model.get_score(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.output.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.output.append(b"")
            else:
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError("a piece crosses words")
                self.pieces[piece] = i
                self.output.append(piece.replace(SPACE, " ").encode())
        self.longest = max(map(len, self.pieces))
        # by the last byte of a character and the first of the next: whether some piece holds two such characters together
        self.joins = np.zeros(1 << 16, bool)
        for piece in self.pieces:
            raw = piece.replace(SPACE, GAP).encode()
            inner = [k for k in range(1, len(raw)) if raw[k] & 0xC0 != 0x80]
            self.joins[[raw[k - 1] << 8 | raw[k] for k in inner]] = True
        self.joins.reshape(256, 256)[:, 0x80:0xC0] = True


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def stretches(vocab: Vocabulary, texts: pa.ChunkedArray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """Stretches that no piece crosses, in order and coded; each one's row; and whether it begins a pre-token.

    A text that is not empty gets a space in front; the space mark in a text counts as a space. A pre-token is a run of spaces and all
    up to the next space; it is cut further between characters that no piece holds together.
    """
    data, offsets = C.flat_text(texts)
    if MARK in data.tobytes():
        data, offsets = C.flat_text(pc.replace_substring(C.rebuilt(data.tobytes(), offsets), SPACE, GAP))
    filled = np.diff(offsets) > 0
    data = np.insert(data, offsets[:-1][filled], 0x20)
    begins = (offsets[:-1] + np.cumsum(filled) - filled)[filled]
    cut = np.ones(len(data), bool)
    cut[1:] = ~vocab.joins[(data[:-1].astype(np.uint16) << 8) | data[1:]]
    cut[begins] = True
    first = np.zeros(len(data), bool)
    first[begins] = True
    at = np.flatnonzero(cut)
    own = first[at]
    row = np.flatnonzero(filled)[np.cumsum(own) - 1] if len(at) else np.zeros(0, np.int64)
    head = own | ((data[at] == 0x20) & (data[at - 1] != 0x20))
    return C.rebuilt(data.tobytes(), np.append(at, len(data))).dictionary_encode(), row, head
