"""Token ids and exact token counts of whole texts, encoding each distinct piece once.

Both vocabularies split a text before every single space that a visible
character follows, so a text is encoded piece by piece: Arrow splits and
dictionary-encodes the pieces of a slice of texts, the library encodes the
distinct ones, numpy puts the results back in place. Texts with other uses of
spaces (runs, ends, a space before other white space) go whole through the
library.
"""

from __future__ import annotations

import os
from array import array
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from corridor.llm.shared import kept_in_worker, ragged

#: Bytes of text whose pieces are looked up together: the more, the fewer are distinct.
SLICE = 16 << 20
#: Distinct pieces that a worker keeps encoded from one task to the next.
CACHED = 700_000

#: The published pre-tokenisation pattern of the byte-level vocabulary (fixed value).
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_PLAIN = regex.compile(r"[\n\r\t -~¡-ɏ]*")


def pieces(texts: pa.Array, extra: str = "") -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    """(pieces after a space, pieces at a text's start, piece index of each place, place offsets by text).

    Indices from len(first list) on point into the second list. A text that can't be cut is one piece.
    """
    cut = pc.split_pattern(texts, " ")
    flat, offsets = cut.flatten(), np.asarray(cut.offsets).astype(np.int64)
    offsets -= offsets[0]
    lead = offsets[:-1]
    coded = flat.dictionary_encode()
    later, index = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    good = np.fromiter((bool(x) and ("!" <= x[0] <= "~" or x[0].isalnum()) and not (extra and extra in x) for x in later), bool, len(later))
    start = flat.take(pa.array(lead)).dictionary_encode()
    firsts = start.dictionary.to_pylist()
    fine = good[index] if len(index) else np.zeros(0, bool)
    first_fine = np.fromiter((not (extra and extra in x) for x in firsts), bool, len(firsts))
    if len(lead):
        # a text's first piece may be any text, as long as an empty one stands alone
        alone = np.diff(offsets) == 1
        empty = np.fromiter((x == "" for x in firsts), bool, len(firsts))[start.indices.to_numpy()]
        fine[lead] = (~empty | alone) & first_fine[start.indices.to_numpy()]
        index[lead] = start.indices.to_numpy().astype(np.int64) + len(later)
        whole = np.flatnonzero(np.add.reduceat(~fine, lead) > 0)
        if len(whole):
            counts = np.diff(offsets)
            keep = np.ones(len(index), bool)
            keep[ragged(lead[whole], counts[whole])] = False
            keep[lead[whole]] = True
            index[lead[whole]] = len(later) + len(firsts) + np.arange(len(whole))
            firsts += texts.take(pa.array(whole)).to_pylist()
            counts[whole] = 1
            index, offsets = index[keep], np.concatenate([[0], np.cumsum(counts)])
    return later, firsts, index, offsets


class ByteLevel:
    """The byte-level vocabulary through the tokenizers library, with a bounded cache of pre-tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.wide = self.library.get_vocab_size() > 1 << 16
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        self.cache: dict[str, bytes] = {}
        self.special = sorted(t.content for t in self.library.get_added_tokens_decoder().values())

    @staticmethod
    def parts(piece: str, after_space: bool) -> list[str]:
        """Pre-tokens of a piece; a piece with rarer characters stays whole for the library."""
        text = " " + piece if after_space else piece
        if piece.isalpha():
            return [text]
        if piece[:-1].isalpha() and piece[-1] in ".,;:!?":
            return [text[:-1], piece[-1]]
        return PATTERN.findall(text) if _PLAIN.fullmatch(text) else [text]

    def encoded(self, piece_texts: list[str], after_space: bool) -> list[bytes]:
        """Ids of each piece as packed bytes."""
        cache = self.cache
        texts = [" " + p for p in piece_texts] if after_space else piece_texts
        # a piece of letters alone is one pre-token; only the others are taken apart
        whole = [*map(str.isalpha, piece_texts)]
        marked = any(s in "\n".join(piece_texts) for s in self.special)
        parts = [[] if alone or not p else [t] if marked and any(s in p for s in self.special) else self.parts(p, after_space)
                 for p, t, alone in zip(piece_texts, texts, whole, strict=True)]
        new = {t for t, alone in zip(texts, whole, strict=True) if alone and t not in cache}
        new.update(x for one in parts for x in one if x not in cache)
        wanted = list(new)
        for at in range(0, len(wanted), 20_000):
            block = wanted[at : at + 20_000]
            for text, coded in zip(block, self.library.encode_batch_fast(block, add_special_tokens=False), strict=True):
                cache[text] = array(self.kind.char, coded.ids).tobytes()
        out = [cache[t] if alone else b"".join([cache[x] for x in one]) for t, alone, one in zip(texts, whole, parts, strict=True)]
        # beyond the bound, and where long, new entries go again
        keep = max(0, CACHED - len(cache) + len(wanted))
        for text in wanted[keep:] + [x for x in wanted[:keep] if len(x) > 64]:
            del cache[text]
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All token ids of the texts, and offsets by text."""
        later, firsts, index, offsets = pieces(texts)
        coded = self.encoded(later, True) + self.encoded(firsts, False)
        lengths = np.fromiter(map(len, coded), np.int64, len(coded)) // self.kind.itemsize
        pool = np.frombuffer(b"".join(coded), self.kind)
        starts = np.cumsum(lengths) - lengths
        n = lengths[index]
        ends = np.concatenate([[0], np.cumsum(n)])
        return pool[ragged(starts[index], n)], ends[offsets]


class Pieces:
    """The sentencepiece vocabulary: token counts of pieces, with a bounded cache."""

    #: The sign that stands for a space inside this vocabulary (fixed value).
    SPACE = "▁"

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.cache: dict[str, int] = {}
        #: Counts at every prefix of units, once asked for (token_counts).
        self.prefixes: Any = None

    def counts(self, piece_texts: list[str]) -> np.ndarray:
        """Tokens of each text, encoded on its own."""
        cache = self.cache
        new = [x for x in piece_texts if x not in cache]
        fresh: dict[str, int] = {}
        for at in range(0, len(new), 20_000):
            block = new[at : at + 20_000]
            fresh.update(zip(block, map(len, self.library.encode(block, num_threads=1)), strict=True))
        out = np.fromiter((cache[x] if x in cache else fresh[x] for x in piece_texts), np.int64, len(piece_texts))
        for x, n in fresh.items():
            if len(cache) >= CACHED:
                break
            if len(x) <= 64:
                cache[x] = n
        return out


def byte_level(path: str) -> ByteLevel:
    return kept_in_worker(("byte", path), lambda: ByteLevel(path))


def piece_model(path: str) -> Pieces:
    return kept_in_worker(("piece", path), lambda: Pieces(path))
