"""Column functions over text: script classes, character grams, references, spans.

All offsets count Unicode code points. `HAN` and `LETTER` are regex class bodies; every job that
depends on a script takes one of them (or another class body) as a parameter.
"""
from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Han blocks counted as script characters.
HAN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}"
# The narrower test a citable run must pass.
HAN_RUN = r"\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}"
LETTER = r"\p{L}"

SPACE = r"[\s\x{1C}-\x{1F}]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def script_text(c, cls: str = HAN) -> Column:
    """Only the characters of the class, in order (F2, without offsets)."""
    return F.regexp_replace(_col(c), f"[^{cls}]+", "")


def script_count(c, cls: str = HAN) -> Column:
    """How many characters of the class the text holds (F1)."""
    return F.length(script_text(c, cls))


def has_script(c, cls: str = HAN) -> Column:
    return _col(c).rlike(f"[{cls}]")


def all_script(c, cls: str = HAN) -> Column:
    return _col(c).rlike(f"^[{cls}]+$")


def script_offsets(c, cls: str = HAN) -> Column:
    """0-based positions, in the original text, of its class characters (F2)."""
    chars = F.split(_col(c), "")
    kept = F.transform(chars, lambda ch, i: F.when(ch.rlike(f"^[{cls}]$"), i))
    return F.filter(kept, lambda i: i.isNotNull())


def grams_of_length(c, n: int, cls: str | None = None) -> Column:
    """Every run of `n` characters, overlaps included, in text order.

    A zero-width look-ahead walks the text once inside the JVM; with `cls` only grams made wholly
    of that class come out. The first character may not be a trailing surrogate, because the
    matcher also stops in the middle of a supplementary character.
    """
    if cls is None:
        body = r"[^\x{DC00}-\x{DFFF}]" + (f".{{{n - 1}}}" if n > 1 else "")
    else:
        body = f"[{cls}]{{{n}}}"
    return F.regexp_extract_all(_col(c), F.lit(f"(?s)(?=({body}))"), F.lit(1))


def char_grams(c, lengths: Sequence[int] = (2, 3, 4), cls: str | None = None) -> Column:
    """All character n-grams of the given lengths as one array."""
    parts = [grams_of_length(c, n, cls) for n in lengths]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def strip_space(c) -> Column:
    """Trim every Unicode white space character, not blanks only."""
    return F.regexp_replace(_col(c), f"(?U)^{SPACE}+|{SPACE}+$", "")


def strip_markup(c) -> Column:
    """Tags removed and white space collapsed; for display only, offsets are lost."""
    return F.regexp_replace(strip_space(F.regexp_replace(_col(c), "<[^>]+>", "")), f"(?U){SPACE}+", " ")


# Latin letters that carry exactly one combining mark, and their base letters.
_MARKED = [
    (chr(o), unicodedata.normalize("NFD", chr(o))[0])
    for o in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]
    if len(unicodedata.normalize("NFD", chr(o))) == 2
    and unicodedata.combining(unicodedata.normalize("NFD", chr(o))[1])
]
_FROM, _TO = "".join(a for a, _ in _MARKED), "".join(b for _, b in _MARKED)


def fold(c) -> Column:
    """Case and single diacritics folded, everything but letters and digits dropped (C4)."""
    return F.regexp_replace(F.translate(F.lower(_col(c)), _FROM, _TO), r"[^\p{L}\p{N}]+", "")


def first_at(text, needle) -> Column:
    """0-based offset of the first occurrence, -1 when absent."""
    return F.position(_col(needle), _col(text)) - 1


def occurs_again(text, needle) -> Column:
    """True when a second, possibly overlapping, occurrence follows the first."""
    text, needle = _col(text), _col(needle)
    return F.position(needle, text, F.position(needle, text) + 1) > 0


def is_unique_in(text, needle) -> Column:
    text, needle = _col(text), _col(needle)
    return (F.position(needle, text) > 0) & ~occurs_again(text, needle)


def slice_text(text, start, length) -> Column:
    """Python-style slice by a 0-based offset and a length."""
    return F.substring(_col(text), start + 1, length)


def sha256(c) -> Column:
    return F.sha2(_col(c), 256)


def model_family(c) -> Column:
    """Provider prefix of a model id: text before the first slash, trimmed, lower case (F8)."""
    c = _col(c)
    return F.coalesce(F.lower(strip_space(F.substring_index(c, "/", 1))), F.lit(""))


# --- references in catalogue and archive names ---------------------------------------------------
# The shapes of unit ids, entry names and reader addresses.
UNIT_WORK_RE = r"^(T\d{4})(?!\d)"
ENTRY_REF_RE = r"([A-Z]{1,2}\d+n[A-Za-z]?\d+[A-Za-z]?)"
T_REF_RE = r"(T\d+n\d+[A-Za-z]?)"
T_NUMBER_RE = r"^T\d+n0*(\d+[A-Za-z]?)$"
WORK_TOKEN_RE = r"(?<![0-9a-zA-Z])([A-Z]{1,2})(\d+)n([0-9a-zA-Z]+)(?![0-9a-zA-Z])"
FASCICLE_RE = r"_(\d+)\.xml\b"
READER_BASE = "https://cbetaonline.dila.edu.tw"


def _blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def work_of(uid) -> Column:
    """Work a unit belongs to, null when the id has no such prefix."""
    return _blank_to_null(F.regexp_extract(_col(uid), UNIT_WORK_RE, 1))


def file_name(path) -> Column:
    return F.substring_index(_col(path), "/", -1)


def entry_ref(path) -> Column:
    """Canonical reference named by an archive entry, null when there is none."""
    return _blank_to_null(F.regexp_extract(file_name(path), ENTRY_REF_RE, 1))


def t_number(path) -> Column:
    """Bare, lower-case work number of a T entry (leading zeros dropped), else null."""
    ref = F.regexp_extract(file_name(path), T_REF_RE, 1)
    return _blank_to_null(F.lower(F.regexp_extract(ref, T_NUMBER_RE, 1)))


def strip_letters(number) -> Column:
    return F.regexp_replace(F.lower(_col(number)), "[a-z]+$", "")


def work_id(ref) -> Column:
    """Reader work id: collection plus number, null when unrecognised."""
    ref = _col(ref)
    return F.when(
        ref.rlike(WORK_TOKEN_RE),
        F.concat(F.regexp_extract(ref, WORK_TOKEN_RE, 1), F.regexp_extract(ref, WORK_TOKEN_RE, 3)),
    )


def fascicle(ref) -> Column:
    return F.regexp_extract(_col(ref), FASCICLE_RE, 1).try_cast("int")


def reader_url(ref, lang: str = "zh") -> Column:
    """Reader address of the work, with a three-digit fascicle when the reference names one."""
    work, n = work_id(ref), fascicle(ref)
    base = F.concat(F.lit(f"{READER_BASE}/{lang}/"), work)
    padded = F.when(F.length(n.cast("string")) > 3, n.cast("string")).otherwise(F.lpad(n.cast("string"), 3, "0"))
    return F.when(n.isNotNull() & (n != 0), F.concat(base, F.lit("_"), padded)).otherwise(base)


def unit_reader_url(uid, lang: str = "zh") -> Column:
    work = F.regexp_extract(_col(uid), r"^(T\d{4})(?:-[A-Za-z0-9][A-Za-z0-9.-]*)?$", 1)
    return F.when(work != "", F.concat(F.lit(f"{READER_BASE}/{lang}/"), work))


# --- small readings of stored text ----------------------------------------------------------------
def grounding_phrase(c) -> Column:
    """Phrase and hit count of a stored grounding search, null when the text is something else (F16)."""
    pattern = r"(?s)^grounding: (['\"])(.*)\1 \((\d+) hits\)$"
    c = _col(c)
    return F.when(
        c.rlike(pattern),
        F.struct(
            F.regexp_extract(c, pattern, 2).alias("phrase"),
            F.regexp_extract(c, pattern, 3).cast("bigint").alias("hits"),
        ),
    )


def elapsed_seconds(start, end) -> Column:
    """Whole seconds between two ISO timestamps, never negative, null while open."""
    micros = F.unix_micros(F.to_timestamp(_col(end))) - F.unix_micros(F.to_timestamp(_col(start)))
    return F.greatest(F.lit(0), F.floor(micros / 1e6 + 0.5)).cast("bigint")


def json_field(c, path: str) -> Column:
    """One JSON field as the bytes that were stored."""
    return F.get_json_object(_col(c), path)


def word_count(c) -> Column:
    trimmed = strip_space(c)
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, f"(?U){SPACE}+")))
