"""Text expressions. Everything here stays in the JVM; no Python workers.

Patterns avoid engine-specific syntax where possible (``\\x{..}`` instead of a
Unicode flag), because a flag such as ``(?U)`` slows every character class.
"""

from __future__ import annotations

import html.entities
import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() and \s remove, as the inside of a class.
SPACE_CLASS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
_SPACE_NOT_U20 = SPACE_CLASS.replace(r"\x1c-\x20", r"\x1c-\x1f")
WORD_CLASS = r"\p{L}\p{N}_"

# One well-formed UTF-8 sequence whose bytes are written as the characters
# U+0000..U+00FF (RFC 3629, table of well-formed byte sequences).
UTF8_SEQUENCE = (
    r"[\x00-\x7F]"
    r"|[\x{C2}-\x{DF}][\x{80}-\x{BF}]"
    r"|\x{E0}[\x{A0}-\x{BF}][\x{80}-\x{BF}]"
    r"|[\x{E1}-\x{EC}\x{EE}\x{EF}][\x{80}-\x{BF}]{2}"
    r"|\x{ED}[\x{80}-\x{9F}][\x{80}-\x{BF}]"
    r"|\x{F0}[\x{90}-\x{BF}][\x{80}-\x{BF}]{2}"
    r"|[\x{F1}-\x{F3}][\x{80}-\x{BF}]{3}"
    r"|\x{F4}[\x{80}-\x{8F}][\x{80}-\x{BF}]{2}"
)

_HIDDEN_ELEMENTS = ("script", "style", "template", "rt", "rp")
MARKUP = (
    r"(?is)<!--.*?-->"
    + "".join(rf"|<{e}\b[^>]*>.*?(?:</{e}\b[^>]*>|\z)" for e in _HIDDEN_ELEMENTS)
    + r"""|</?[a-z](?:[^'">]+|"[^"]*"|'[^']*')*+>|</?[a-z][^>]*>|<![^>]*>|<\?[^>]*>"""
)


def is_blank(c: Column) -> Column:
    """True for null, empty and whitespace-only text."""
    return F.coalesce(~c.rlike(f"[^{SPACE_CLASS}]"), F.lit(True))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$", "")


def collapse_space(c: Column) -> Column:
    """Runs of whitespace become one space; none at the ends.

    The pattern passes over single spaces, which need no replacement.
    """
    return F.trim(
        F.regexp_replace(c, f"[{_SPACE_NOT_U20}][{SPACE_CLASS}]*| [{SPACE_CLASS}]+", " ")
    )


def no_spaces(c: Column) -> Column:
    """Lower-case text without U+0020."""
    return F.replace(F.lower(c), F.lit(" "), F.lit(""))


def one_line(c: Column) -> Column:
    """Line breaks to spaces, stripped, null to the empty string."""
    return F.coalesce(strip(F.translate(c, "\r\n", "  ")), F.lit(""))


def repair_text(c: Column, mode: str = "always") -> Column:
    """Undo UTF-8 text that was decoded as latin-1 (``cafÃ©`` to ``café``).

    The text is read as latin-1 bytes and decoded as UTF-8, and whatever does
    not fit either step is dropped: characters above U+00FF and lone accented
    letters vanish. ``mode="safe"`` leaves text alone that shows no sign of
    the damage. ASCII text, the common case, is passed through untouched.
    """
    latin = F.regexp_replace(c, r"[^\x00-\x{FF}]", "")
    valid = F.regexp_replace(latin, rf"((?:[\x00-\x7F]++|{UTF8_SEQUENCE})++)|(?s:.)", "$1")
    repaired = F.encode(valid, "ISO-8859-1").cast("string")
    if mode == "always":
        wanted = c.rlike(r"[^\x00-\x7F]")
    elif mode == "safe":
        wanted = c.rlike(r"[\x{C2}-\x{F4}][\x{80}-\x{BF}]")
    else:
        raise ValueError(f"unknown repair mode {mode!r}")
    return F.when(wanted, repaired).otherwise(c)


def _entity_table() -> str:
    """Named entities, and numeric ones that mean windows-1252 characters."""
    table = {k[:-1]: v for k, v in html.entities.html5.items() if k.endswith(";")}
    for code in range(128, 160):
        char = bytes([code]).decode("windows-1252", "ignore")
        if char:
            table[f"#{code}"] = char
    return json.dumps(table)


def _stages(c: Column, *steps: Callable[[Column], Column]) -> Column:
    """A one-element array with ``c`` passed through the steps.

    Each step sees the result of the one before as a bound lambda variable.
    Nesting the expressions instead would copy the whole inner expression for
    every mention of its result, and evaluate each copy.
    """
    value = F.array(c)
    for step in steps:
        value = F.transform(value, step)
    return value


def _once(c: Column, *steps: Callable[[Column], Column]) -> Column:
    return F.element_at(_stages(c, *steps), 1)


def decode_entities(c: Column) -> Column:
    """Decode HTML entities, each exactly once (``&amp;lt;`` gives ``&lt;``).

    Splits at ``&`` and looks at the head of every piece, so that no decoded
    text is decoded again. Unknown names keep their ``&`` and lose a closing
    semicolon, as an HTML parser reports them.
    """
    table = F.from_json(F.lit(_entity_table()), "map<string,string>")
    entity = r"^(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][-.a-zA-Z0-9]*);?"

    def find_head(piece: Column, index: Column) -> Column:
        head = F.when(index > 0, F.regexp_extract(piece, entity, 0))
        return F.struct(piece.alias("piece"), head.alias("head"))

    def find_code(p: Column) -> Column:
        name = F.rtrim(p["head"], F.lit(";"))
        digits = F.regexp_extract(name, "^#[xX]?0*(.{1,8})$", 1)
        number = F.when(name.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(digits)
        return F.struct(
            F.substring(p["piece"], F.length(p["head"]) + 1, F.length(p["piece"])).alias("rest"),
            p["piece"].alias("piece"),
            name.alias("name"),
            F.when(name.startswith("#"), number.try_cast("long")).alias("code"),
        )

    def decode_piece(p: Column) -> Column:
        code = p["code"]
        usable = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        numeric = F.coalesce(
            F.try_element_at(table, F.concat(F.lit("#"), code.cast("string"))),
            F.when(usable, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")),
            F.lit("\ufffd"),
        )
        char = F.when(p["name"].startswith("#"), numeric).otherwise(
            F.coalesce(F.try_element_at(table, p["name"]), F.concat(F.lit("&"), p["name"]))
        )
        return (
            F.when(p["name"].isNull(), p["piece"])
            .when(p["name"] == "", F.concat(F.lit("&"), p["piece"]))
            .otherwise(F.concat(char, p["rest"]))
        )

    pieces = F.transform(F.transform(F.split(c, "&"), find_head), find_code)
    return F.when(c.contains("&"), F.array_join(F.transform(pieces, decode_piece), "")).otherwise(c)


def remove_markup(c: Column) -> Column:
    """Tags, comments and hidden elements to spaces; plain text is not searched."""
    return F.when(c.contains("<"), F.regexp_replace(c, MARKUP, " ")).otherwise(c)


def html_to_text(c: Column) -> Column:
    """Visible text of an HTML fragment: text nodes stripped, joined by a space.

    Comments, declarations and the contents of script, style, template and
    ruby annotations are left out.
    """
    return _once(c, remove_markup, decode_entities, collapse_space)


def _drop_emoji_marks(c: Column) -> Column:
    return F.regexp_replace(c, rf"<emoji:[{SPACE_CLASS}]*[^>]+>", "")


def _blank_symbols(c: Column) -> Column:
    return F.when(c.rlike(r"[\p{L}\p{N}]"), c).when(c.isNotNull(), F.lit(""))


_FINISH = (_drop_emoji_marks, collapse_space, _blank_symbols)


def _clean_stages(c: Column, repair: str) -> Column:
    # Whitespace is collapsed once, by the last steps.
    return _stages(c, lambda t: repair_text(t, repair), remove_markup, decode_entities, *_FINISH)


def clean_text(c: Column, repair: str = "always") -> Column:
    """Repair, strip markup, drop ``<emoji: ..>`` marks, collapse whitespace.

    Text without a letter or digit becomes empty; null stays null.
    """
    return F.element_at(_clean_stages(c, repair), 1)


def clean_text_rows(c: Column, repair: str = "always") -> Column:
    """A generator of the clean text: one row, or none where it is blank.

    A filter on a computed column is pushed below its projection and repeats
    the computation; generating the column cleans every text once.
    """
    return F.explode(F.filter(_clean_stages(c, repair), lambda t: ~is_blank(t)))


def words(c: Column) -> Column:
    """Lower-case words of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"[{WORD_CLASS}]{{2,}}"), 0)


def letter_words(c: Column) -> Column:
    """Lower-case words made of two or more ASCII letters and nothing else."""
    pattern = f"(?<![{WORD_CLASS}])[a-z]{{2,}}(?![{WORD_CLASS}])"
    return F.regexp_extract_all(F.lower(c), F.lit(pattern), 0)
