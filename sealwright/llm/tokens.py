"""Token ids of texts by a public tokenizer file.

For a tokenizer that drops white space, a text's ids are those of its pieces (runs of letters, digits, runs of
other signs). Pieces come again and again, so a task keeps the ids of a bounded number of them; the ids
themselves are always the tokenizer's. Texts of plain letters are cut into pieces here, others go to
the tokenizer chunk by chunk.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Pieces that a task keeps; beyond it a new store begins, and the one before serves as its source.
KEPT = 200_000

# The steps of a tokenizer whose pieces this module may cut itself.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_PIECE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: ASCII but control signs: what is left of a plain text without it is letters from U+00C0 to U+00FF.
_ASCII = bytes([*range(0x09, 0x0E), *range(0x20, 0x7F)])
_LATIN = re.compile(rb"(?:\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])*")
#: The piece pattern over lower-cased plain texts, whose normal form is plain too: without letters beyond ASCII, and with.
_SIGNS = rb"'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[\x21-\x2f\x3a-\x60\x7b-\x7e]+"
_ASCII_PIECES = re.compile(rb"[a-z]+|" + _SIGNS)
_PIECES = re.compile(rb"(?:[a-z]+|\xc3[\x9f-\xb6\xb8-\xbf])+|" + _SIGNS)


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_LETTERS = _byte_letters()


class _Store(dict):
    """Ids by piece, made when first asked for; at most ``most`` of them and as many of the time before."""

    def __init__(self, make, most: int):
        self.make, self.most, self.before = make, most, {}

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            ids = self.make(piece)
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Encoder:
    """``width``-byte little-endian ids of texts."""

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: True: the names of special tokens in a text are ordinary text.
        self.tokenizer.encode_special_tokens = plain
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        made = json.loads(self.tokenizer.to_str())
        steps = [n.get("type") for n in (made.get("normalizer") or {}).get("normalizers", [])]
        cut = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.in_pieces = steps == _NORMALIZERS and (cut[0].get("pattern") or {}).get("Regex") == _PIECE_PATTERN and made["post_processor"] is None
        self.model, self.named = self.tokenizer.model, [t["content"].encode() for t in made["added_tokens"]]
        self.pieces, self.chunks = _Store(self._piece, KEPT), _Store(self._chunk, KEPT // 5)

    def encode(self, text: bytes | None) -> bytes:
        text = text or b""
        if not self.in_pieces:
            return self._packed(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids)
        if self._plain(text):
            return self._in_pieces(text)
        return b"".join(map(self.chunks.__getitem__, text.split()))

    def _plain(self, text: bytes) -> bool:
        return bool(_LATIN.fullmatch(text.translate(None, _ASCII))) and not any(name in text for name in self.named)

    def _in_pieces(self, text: bytes) -> bytes:
        found = _ASCII_PIECES.findall(text.lower()) if text.isascii() else _PIECES.findall(text.decode().lower().encode())
        return b"".join(map(self.pieces.__getitem__, found))

    def _piece(self, piece: bytes) -> bytes:
        letters = piece.decode() if piece.isascii() else "".join(map(_LETTERS.__getitem__, piece))
        return self._packed([t.id for t in self.model.tokenize(letters)])

    def _chunk(self, chunk: bytes) -> bytes:
        """A chunk between ASCII white space; no token reaches across that."""
        if self._plain(chunk):
            return self._in_pieces(chunk)
        return self._packed(self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids)

    def _packed(self, ids: list[int]) -> bytes:
        return array("H" if self.width == 2 else "I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, f"<u{self.width}").tobytes()


@lru_cache(maxsize=2)
def encoder(path: str, plain: bool = False) -> Encoder:
    return Encoder(path, plain)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoded(texts, path: str, last: int, plain: bool = False) -> Iterator[bytes]:
    """Ids of each text, ``last`` at the end; None is an empty text."""
    using = encoder(path, plain)
    end = int(last).to_bytes(using.width, "little")
    for text in texts:
        yield using.encode(text) + end
