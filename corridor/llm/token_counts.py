"""Exact token counts at every prefix of a text, by dynamic programming over its prefixes.

The vocabulary joins neighbouring signs by rank, so a row of pieces is the encoding of its text
exactly if every two neighbours in it are the encoding of their own text. Hence the last piece of
a prefix is the one piece t that ends there and fits behind the last piece of the prefix before it:

    last(i) = t,  count(i) = count(i - |t|) + 1     with t fitting behind last(i - |t|).

A sign outside the vocabulary stands for as many tokens as it has bytes and joins with nothing.
Which piece fits behind which is asked of the library, once for each pair.

No piece of the vocabulary holds a space sign after another sign, so tokens never cross the
start of a run of spaces: a text is a sequence of units (spaces, then other signs), and the
counts of a text are those of its units, shifted by the running sum. Each distinct short unit is
worked out once per worker. ``PrefixCounts`` holds the counts at every prefix of one text and
answers truncation and budget questions by a look-up; ``count_tokens`` takes the counts of whole
tables from the same prefix counts.

Defined results: null and empty texts have no tokens; repeated rows are counted each; other
columns are ignored; an empty table gives an empty result; very long texts are whole, and the
time for a text without any space grows in proportion to its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from corridor.llm.shared import slices, summed, texts_of
from corridor.llm.tokenpieces import CACHED, SLICE, Pieces, piece_model, pieces

_UNIT = re.compile(r" *[^ ]+| +")
#: Units whose counts a worker keeps: up to this length, so that a count fits a byte.
KEPT_UNIT = 60
#: Pairs of pieces that a worker remembers before it starts anew.
KEPT_PAIRS = 500_000
#: A sign of a private-use area, outside the vocabulary: what follows it is encoded as if alone.
_ALONE = "\ue000"


class Prefixes:
    """Counts at every prefix of a unit, the space before it being part of it."""

    def __init__(self, model: Pieces):
        library = model.library
        self.library, self.space = library, model.SPACE
        plain = (i for i in range(library.get_piece_size()) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i)))
        self.vocabulary = {library.id_to_piece(i) for i in plain}
        if _ALONE in self.vocabulary:
            raise ValueError("the vocabulary holds the sign that sets texts apart")
        self.head = len(library.encode(_ALONE))
        # the lengths that pieces with a given last sign have, longest first
        lengths: dict[str, set[int]] = {}
        for piece in self.vocabulary:
            lengths.setdefault(piece[-1], set()).add(len(piece))
        self.lengths = {sign: sorted(some, reverse=True) for sign, some in lengths.items()}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.units: dict[str, bytes] = {}

    def _fits(self, left: str, right: str) -> bool:
        """Whether ``left`` and then ``right`` are the encoding of their text; a left of no signs is a beginning."""
        want = [left, right] if left else [right]
        good = self.library.encode(_ALONE + left + right, out_type=str)[self.head :] == want
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        self.pairs[left, right] = good
        return good

    def _work_out(self, unit: str) -> np.ndarray:
        vocabulary, pairs, lengths = self.vocabulary, self.pairs, self.lengths
        last, count = [""], [0]
        for i, sign in enumerate(unit, 1):
            for n in lengths.get(sign, ()):
                if n > i:
                    continue
                piece = unit[i - n : i]
                if piece in vocabulary:
                    before = last[i - n]
                    good = pairs.get((before, piece))
                    if good if good is not None else self._fits(before, piece):
                        last.append(piece)
                        count.append(count[i - n] + 1)
                        break
            else:
                if sign in lengths and sign in vocabulary:
                    raise ValueError(f"no piece of the vocabulary ends the prefix of {i} signs")
                last.append("")
                count.append(count[-1] + len(sign.encode()))
        return np.array(count, np.int64)

    def of(self, unit: str) -> np.ndarray:
        """Counts of the prefixes of 0, 1, ... signs of a unit; it begins with the space sign."""
        held = self.units.get(unit)
        if held is not None:
            return np.frombuffer(held, np.uint8).astype(np.int64)
        counts = self._work_out(unit)
        if len(unit) <= KEPT_UNIT and len(self.units) < CACHED:
            self.units[unit] = counts.astype(np.uint8).tobytes()
        return counts

    def totals(self, units: list[str]) -> np.ndarray:
        """Tokens of each unit, given without the space before it."""
        held, space = self.units, self.space
        out = np.empty(len(units), np.int64)
        for k, unit in enumerate(units):
            known = held.get(space + unit)
            out[k] = known[-1] if known is not None else self.of(space + unit)[-1]
        return out


def prefixes(model: Pieces) -> Prefixes:
    """The prefix counts of a model, kept with what they learn as long as the model."""
    if model.prefixes is None:
        model.prefixes = Prefixes(model)
    return model.prefixes


class PrefixCounts:
    """Token counts of every prefix (by code points) of one text."""

    def __init__(self, model: Pieces, text: str | None):
        table = prefixes(model)
        found, total = [np.zeros(1, np.int64)], 0
        for i, unit in enumerate(_UNIT.findall((text or "").replace(Pieces.SPACE, " "))):
            # the library puts one space before a text; a later unit brings its own
            own = table.of((Pieces.SPACE if i == 0 else "") + unit.replace(" ", Pieces.SPACE))
            found.append(total + own[2 if i == 0 else 1 :])
            total += int(own[-1])
        self.counts = np.concatenate(found)

    def count(self, n: int | None = None) -> int:
        """Tokens of the first ``n`` code points; of the whole text if none is given."""
        return int(self.counts[-1 if n is None else min(n, len(self.counts) - 1)])

    def longest(self, budget: int) -> int:
        """Code points of the longest prefix with at most ``budget`` tokens."""
        return int(np.flatnonzero(self.counts <= budget)[-1])


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fits): ``fits`` is the longest prefix, in code points, within the limit."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        table = prefixes(model)
        for batch in slices(batches, limit=SLICE):
            texts = texts_of(batch)
            later, firsts, index, offsets = pieces(texts, Pieces.SPACE)
            # a text's first piece may be a whole text that can't be cut at single spaces
            begun = [PrefixCounts(model, x).count() if " " in x or Pieces.SPACE in x or not x else -1 for x in firsts]
            plain = iter(table.totals([x for x, n in zip(firsts, begun, strict=True) if n < 0]).tolist())
            first_own = np.array([n if n >= 0 else next(plain) for n in begun], np.int64)
            own = np.concatenate([table.totals(later), first_own])[index]
            tokens = summed(own, offsets)
            sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            fits = sizes.copy()
            for i in np.flatnonzero(tokens > limit).tolist():
                a, b = int(offsets[i]), int(offsets[i + 1])
                fits[i] = _cut(model, texts[i].as_py(), own[a:b], limit)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").cast(pa.int64()), "n_bytes": pc.binary_length(texts).cast(pa.int64()), "n_tokens": pa.array(tokens),
                "over_limit": pa.array(tokens > limit), "fits": pa.array(fits)})

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fits long")


def _cut(model: Pieces, text: str, own: np.ndarray, limit: int) -> int:
    """As ``PrefixCounts.longest``, from the running sum over pieces where the text was cut at single spaces."""
    if len(own) == 1:
        return PrefixCounts(model, text).longest(limit)
    total = np.cumsum(own)
    j = int(np.searchsorted(total, limit, side="right"))
    units = text.split(" ")
    begin = sum(map(len, units[:j])) + j - 1  # before the space of unit j
    inside = prefixes(model).of(Pieces.SPACE + units[j])
    if j == 0:
        return max(0, int(np.flatnonzero(inside <= limit)[-1]) - 1)
    return begin + int(np.flatnonzero(inside <= limit - int(total[j - 1]))[-1])
