"""Text columns: mojibake repair (P4), slugs (P22), label wording."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wording of measure names in labels.
BALANCE_LABEL = "trade balance"
PLURAL = "countries"
IN_SENTENCE = (("balance", "balance with"), ("exports", "exports to"), ("imports", "imports from"))

# A string is a repair candidate when every character fits in one Latin-1 byte
# and the byte sequence is well-formed UTF-8 containing at least one multi-byte
# character: that is exactly UTF-8 text that was read as Latin-1.
_VALID_UTF8_AS_LATIN1 = (
    "^(?:[\\x{00}-\\x{7F}]"
    "|[\\x{C2}-\\x{DF}][\\x{80}-\\x{BF}]"
    "|[\\x{E0}-\\x{EF}][\\x{80}-\\x{BF}]{2}"
    "|[\\x{F0}-\\x{F4}][\\x{80}-\\x{BF}]{3})*$"
)
_HAS_MULTIBYTE = "[\\x{C2}-\\x{F4}][\\x{80}-\\x{BF}]"


def fix_mojibake(c: Column | str) -> Column:
    """Undo UTF-8-read-as-Latin-1 damage (``CÃ´te`` -> ``Côte``).

    Correct names (including ones with real Latin-1 accents), ASCII and
    non-Latin scripts fail the guard and pass through unchanged.
    """
    c = F.col(c) if isinstance(c, str) else c
    damaged = c.rlike(_VALID_UTF8_AS_LATIN1) & c.rlike(_HAS_MULTIBYTE)
    return F.when(damaged, F.decode(F.encode(c, "ISO-8859-1"), "UTF-8")).otherwise(c)


#: Signs that Windows-1252 has for the bytes 80 to 9F (fixed values, by the codec); five bytes have none.
CP1252 = {bytes([b]).decode("cp1252"): chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
#: Repairs in a row; text damaged more often than that keeps the rest.
ROUNDS = 8


def damage(c: Column) -> Column:
    """How many characters of the text look like a longer UTF-8 sequence read byte by byte."""
    return F.regexp_count(_as_bytes(c), F.lit(_HAS_MULTIBYTE + "+"))


def _as_bytes(c: Column) -> Column:
    """One character per byte: Windows-1252 signs as the bytes they stand for."""
    return F.translate(c, "".join(CP1252), "".join(CP1252.values()))


def fix_mojibake_repeated(c: Column | str, rounds: int = ROUNDS) -> Column:
    """Undo UTF-8 read as Latin-1 or Windows-1252, however often it happened.

    A step reads the text's bytes as UTF-8 if they are that and hold a longer sequence, and is
    taken only if it lowers the damage count; steps repeat until nothing changes (at most
    ``rounds``). Undamaged text, with accents, curly quotes or other scripts, is no UTF-8 when taken
    as bytes, and stays as it is.
    """
    c = F.col(c) if isinstance(c, str) else c

    def step(text: Column) -> Column:
        raw = _as_bytes(text)
        better = F.decode(F.encode(raw, "ISO-8859-1"), "UTF-8")
        fits = raw.rlike(_VALID_UTF8_AS_LATIN1) & raw.rlike(_HAS_MULTIBYTE)
        return F.when(fits & (damage(better) < damage(text)), better).otherwise(text)

    # a fold, so that the expression doesn't grow with the rounds
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), c, lambda text, _: step(text))


def slug(c: Column | str) -> Column:
    """File-safe form: lower case, whitespace runs -> ``_``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(c), r"\s+", "_")


def label(c: Column | str, capitalize: bool = True, in_sentence: bool = False, file_mode: bool = False,
          genitive: bool = False, verb: str | None = None) -> Column:
    """Display wording of a flow/measure or country name.

    ``balance`` reads "trade balance"; in a sentence the flows take their
    preposition; the first character is upper-cased; file mode slugs it. The
    genitive adds ``'s``, or ``'`` after an s; a verb in the third person
    follows, in the plural after names that end with "countries".
    """
    c = F.col(c) if isinstance(c, str) else c
    out = F.regexp_replace(c, "^(.*?)balance", f"$1{BALANCE_LABEL}")  # first occurrence only
    if in_sentence:
        for word, phrase in IN_SENTENCE:
            out = F.regexp_replace(out, rf"^(.*?)\b{word}\b", f"$1{phrase}")  # first occurrence only
    if capitalize:
        out = F.concat(F.upper(F.substring(out, 1, 1)), F.substring(out, 2, 1 << 30))
    if file_mode:
        out = slug(out)
    if genitive:
        out = F.concat(out, F.when(F.endswith(out, F.lit("s")), "'").otherwise("'s"))
    if verb:
        plural = verb[:-1] if verb.endswith("s") else verb
        out = F.concat(out, F.lit(" "), F.when(F.endswith(out, F.lit(PLURAL)), plural).otherwise(verb))
    return out
