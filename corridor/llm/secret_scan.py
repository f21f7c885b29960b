"""Secret scans with linking of credential parts.

Strong spans stand alone: assignments to a telling name, access identifiers, long hexadecimal
runs. Weak candidates (random-looking strings, short hexadecimal runs, login names, end
points) are common in harmless text; they are reported only when complementary parts of one
credential lie in one scope: at most ``SCOPE`` code points apart with no blank line between.
An identifier needs a secret near it, an end point a secret, a weak secret an identifier or an
end point; strong spans count as parts (access: identifier; assign and hex: secret). The link
is an interval join by nearest neighbours over sorted intervals: its work grows with the parts,
not with their pairs.

Defined results: a null or empty text has no spans; spans are code points, end exclusive, kind
order as listed in ``KINDS``; repeated rows are scanned each; other columns are ignored; an
empty table gives an empty result; whole texts are scanned, of any length.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from corridor.llm.shared import slices, texts_of

KINDS = ("assign", "access", "hex", "secret", "identifier", "endpoint")
SCOPE = 200

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/=_-])(?:[0-9a-f]{16,23}|[A-Za-z0-9+/_-]{20,}={0,2})(?![A-Za-z0-9+/=_-])")
_IDENTIFIER = re.compile(r"""\b(?:user(?:name|_id)?|login|client_?id|account(?:_?id)?|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.I | re.A)
_ENDPOINT = re.compile(r"""\b(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\s"'<>]{4,}|\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+\.[a-z]{2,}""", re.I | re.A)
#: A text without a match of this has no span of any kind (a weak secret or identifier needs a partner named here or is one).
_MAYBE = r"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{16}|[A-Za-z0-9+/_-]{20}"

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """The strong spans, by start and kind."""
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _random_looking(s: str) -> bool:
    """Digits and both cases (or hexadecimal digits), spread evenly."""
    hexadecimal = re.fullmatch("[0-9a-f]+", s) is not None
    if not any(c.isdigit() for c in s) or not any(c.isalpha() for c in s):
        return False
    if not hexadecimal and (s.islower() or s.isupper()):
        return False
    bits = -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())
    return bits >= (2.8 if hexadecimal else 3.5)


class _Part:
    """Disjoint intervals of one role, sorted."""

    def __init__(self, spans: list[Span]):
        self.spans = sorted(spans)
        self.starts = [s[0] for s in self.spans]

    def near(self, span: Span, blanks: list[int]) -> bool:
        """Whether a part of this role, other than the span, lies in the span's scope."""
        at = bisect_left(self.starts, span[0])
        for k in (at - 2, at - 1, at, at + 1):
            if 0 <= k < len(self.spans) and self.spans[k][:2] != span[:2]:
                other = self.spans[k]
                low, high = min(span[1], other[1]), max(span[0], other[0])
                if high - low <= SCOPE and bisect_left(blanks, low) == bisect_left(blanks, high):
                    return True
        return False


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    """Weak candidates that a complementary part confirms and that overlap no strong span."""
    covered = sorted((s[0], s[1]) for s in base)

    def free(s: Span) -> bool:
        at = bisect_left(covered, (s[1], 0))
        return not any(covered[k][1] > s[0] for k in range(max(0, at - 3), at))

    def spans(pattern: re.Pattern[str], kind: str) -> list[Span]:
        return [s for m in pattern.finditer(text) if free(s := (m.start(), m.end(), kind))]

    weak = [s for s in spans(_WEAK_SECRET, "secret") if _random_looking(text[s[0] : s[1]])]
    names, points = spans(_IDENTIFIER, "identifier"), spans(_ENDPOINT, "endpoint")
    taken = sorted((s[0], s[1]) for s in names + points)
    weak = [s for s in weak if not any(a < s[1] and b > s[0] for a, b in taken[max(0, bisect_left(taken, (s[0], 0)) - 2) : bisect_left(taken, (s[1], 0)) + 1])]
    if not (weak or names or points):
        return []
    blanks = [m.start() for m in re.finditer(r"\n\s*\n", text)]
    secrets = _Part(weak + [s for s in base if s[2] in ("assign", "hex")])
    keys = _Part(names + [s for s in base if s[2] == "access"])
    ends = _Part(points)
    found = [s for s in weak if keys.near(s, blanks) or ends.near(s, blanks)]
    found += [s for s in names + points if secrets.near(s, blanks)]
    return found


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(strong spans, all spans), both by start and kind."""
    base = base_spans(text)
    return base, sorted(base + linked_spans(text, base), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced; overlapping spans are one."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_linked, base_sha256, spans) for every document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = texts_of(batch)
            rows = [([], [])] * len(texts)
            for i in pc.indices_nonzero(pc.match_substring_regex(texts, _MAYBE)).to_pylist():
                rows[i] = all_spans(texts[i].as_py())
            count = lambda kind: [sum(s[2] == kind for s in base) for base, _ in rows]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").cast(pa.int64()), "n_assign": pa.array(count("assign"), pa.int64()),
                "n_access": pa.array(count("access"), pa.int64()), "n_hex": pa.array(count("hex"), pa.int64()),
                "n_linked": pa.array([len(every) - len(base) for base, every in rows], pa.int64()),
                "base_sha256": pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in rows], pa.string()),
                "spans": pa.array([joined(every) for _, every in rows], pa.string())})

    return docs.select("doc_id", "text").mapInArrow(
        scan, "doc_id long, n_assign long, n_access long, n_hex long, n_linked long, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with every reported span of ``text`` replaced by its kind."""
    at = docs.columns.index("text")

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text")
            hits = pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(texts, _MAYBE), False)).to_pylist()
            changed = {i: new for i in hits if (new := redacted(t := texts[i].as_py(), all_spans(t)[1])) != t}
            if changed:
                whole = texts.to_pylist()
                for i, new in changed.items():
                    whole[i] = new
                batch = batch.set_column(at, batch.schema.field(at), pa.array(whole, texts.type))
            yield batch

    return docs.mapInArrow(mask, docs.schema)
