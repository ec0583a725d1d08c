"""Text features of payloads and HTTP fields."""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StructType

# Typographic marks that the character model knows, with their codes.
MARK_CODES = {"’": (134, 132), "”": (129,), "“": (130,), "‘": (131,), "–": (133,)}
FRAME = 10_000  # codes in one 100 x 100 frame
CODE_SCALE = 128


def extract_tag(s: Column) -> Column:
    """From the first ``<`` of the first line that holds a tag to the last ``>`` of that line.

    ``[^\\n]`` rather than ``.``: Java's dot also stops at other line ends.
    """
    return F.regexp_extract(s, "<[^\n]*>", 0)


def url_unquote(s: Column) -> Column:
    """Percent-decode; ``+`` stays, malformed escapes stay, bad UTF-8 becomes U+FFFD."""
    escaped = F.regexp_replace(s, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(F.regexp_replace(escaped, "[+]", "%2B"))


def strip(s: Column) -> Column:
    """Remove all white space at both ends, not only blanks."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+\z", "")


def form_values(form: Column) -> Column:
    """Values of a rendered form: on lines with ``Value:`` the text after the last colon."""
    plain = F.regexp_replace(form, "\x1b\\[0m\x1b\\[1m", "")
    lines = F.filter(F.split(plain, "\n"), lambda line: F.contains(line, F.lit("Value:")))
    return F.transform(lines, lambda line: strip(F.substring_index(strip(line), ":", -1)))


def code_text(s: Column) -> Column:
    """Text whose characters *are* the model's codes (U+0000 to U+0086); others are dropped.

    Kept as a string, one character per code, until an array is really needed.
    """
    known = "".join(MARK_CODES)
    kept = F.regexp_replace(s, f"[^\\x00-\\x80{known}]", "")
    for mark, codes in MARK_CODES.items():
        kept = F.replace(kept, F.lit(mark), F.lit("".join(map(chr, codes))))
    return kept


def codes(code_text: Column) -> Column:
    """Array of the codes of ``code_text``."""
    none = F.array().cast("array<int>")
    return F.when(code_text == "", none).otherwise(F.transform(F.split(code_text, ""), lambda c: F.ascii(c)))


def char_codes(s: Column) -> Column:
    return codes(code_text(s))


def frames(code_text: Column) -> Column:
    """Cut into frames of 10 000 codes; at least one, so that an empty text is scored as well."""
    last = F.greatest(F.ceil(F.length(code_text) / FRAME), F.lit(1)) - 1
    return F.transform(
        F.sequence(F.lit(0), last.cast("int")),
        lambda k: F.substr(code_text, k * FRAME + 1, F.lit(FRAME)),
    )


def frame_vector(frame: Column) -> Column:
    """Frame as 10 000 doubles in row-major order: code / 128, zeros at the end."""
    values = F.transform(codes(frame), lambda c: c / F.lit(float(CODE_SCALE)))
    return F.concat(values, F.array_repeat(F.lit(0.0), F.lit(FRAME) - F.size(values)))


def frame_sparse(frame: Column) -> Column:
    """The same as an MLlib sparse vector, of the places that have a code; its size is that of the text.

    A vector column is a struct inside; no built-in function makes a sparse one, but the JSON reader does.
    """
    found = F.filter(
        F.transform(codes(frame), lambda c, i: F.struct(i.alias("at"), (c / F.lit(float(CODE_SCALE))).alias("value"))),
        lambda p: p.value != 0,
    )
    row = F.struct(
        F.lit(0).alias("type"),
        F.lit(FRAME).alias("size"),
        found["at"].alias("indices"),
        found["value"].alias("values"),
    )
    kind = StructType().add("x", VectorUDT())
    return F.from_json(F.to_json(F.struct(row.alias("x"))), kind)["x"]


def hex_text(h: Column) -> Column:
    """UTF-8 text given as hex digits; null when either encoding is broken."""
    pairs = h.rlike(r"^[0-9A-Fa-f]*\z") & (F.length(h) % 2 == 0)
    return F.try_validate_utf8(F.when(pairs, F.unhex(h)).cast("string"))


def tokens(s: Column) -> Column:
    """Lower-case words of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(s), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def trim_ftp_text(text: Column, file_name: Column) -> Column:
    """File content out of a rendered text layer.

    The first line is a heading.  The second loses its first character; then every line loses
    surrounding tabs and its last 3 characters, 6 for ``.txt`` files, and ends with a newline.
    """
    unix = F.regexp_replace(text, "\r\n?", "\n")
    lines = F.regexp_extract_all(unix, F.lit("[^\n]*\n|[^\n]+$"), F.lit(0))
    body = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    cut = F.when(F.lower(file_name).endswith(".txt"), 6).otherwise(3)

    def trimmed(line: Column, i: Column) -> Column:
        line = F.when(i == 0, F.substr(line, F.lit(2))).otherwise(line)
        line = F.regexp_replace(line, r"^\t+|\t+\z", "")
        kept = F.greatest(F.length(line) - cut, F.lit(0))
        return F.concat(F.substr(line, F.lit(1), kept), F.lit("\n"))

    return F.array_join(F.transform(body, trimmed), "")
