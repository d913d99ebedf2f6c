"""Text, id and array functions; every one is a built-in column expression."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no link evidence.
STOPWORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can need dare ought "
    "used to of in for on with at by from as into through during before after above below between out off over under again further then "
    "once here there when where why how all each every both few more most other some such no nor not only own same so than too very "
    "just because but and or if while that this it its you your we our they them their i me my he him his she her who whom which what about up down "
    "let get got also make made"
).split()

# Colours of note kinds.
NOTE_COLORS = {
    "decision": "#8aa2ff", "fact": "#2196F3", "issue": "#f44336", "question": "#FFC107",
    "summary": "#f97316", "turn": "#06b6d4", "concept": "#7c3aed", "example": "#00BCD4",
}
OTHER_COLOR = "#757575"
PRIORITIES = ("low", "medium", "high")
STATUSES = ("todo", "in_progress", "blocked", "done")
MEMORY_STATES = ("hot", "warm", "compacted")


def slug(topic: Column) -> Column:
    """Lower-case; runs of anything but a-z and 0-9 become one hyphen; none at the ends; empty: general."""
    dashed = F.regexp_replace(F.lower(topic), "[^a-z0-9]+", "-")
    trimmed = F.regexp_replace(dashed, "^-|-$", "")
    return F.coalesce(F.when(trimmed != "", trimmed), F.lit("general"))


def slug_of(topic: str | None) -> str:
    """``slug`` of one text, outside Spark."""
    return re.sub("^-|-$", "", re.sub("[^a-z0-9]+", "-", (topic or "").lower())) or "general"


def tokens(text: Column) -> Column:
    """Distinct runs of three or more letters a-z, lower-cased, without stopwords."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-zA-Z]{3,}"), F.lit(0))
    return F.array_except(found, F.array(*[F.lit(w) for w in STOPWORDS if len(w) > 2]))


def words(text: Column) -> Column:
    """Distinct lower-cased runs between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""))


def _accents() -> tuple[str, str]:
    """Latin letters with accents and the letters below them, then the combining accents, which have no counterpart."""
    kept, plain = [], []
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(c))
        if len(parts) > 1 and all(unicodedata.combining(x) for x in parts[1:]):
            kept.append(chr(c))
            plain.append(parts[0])
    return "".join(kept) + "".join(map(chr, range(0x300, 0x370))), "".join(plain)


ACCENTED, UNACCENTED = _accents()


def fold(text: Column) -> Column:
    """Lower-case, without accents on Latin letters; null is empty."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.rlike("[^\\x00-\\x7f]"), F.translate(low, ACCENTED, UNACCENTED)).otherwise(low)


def terms(text: Column) -> Column:
    """The terms of a text, in order: runs of letters and digits of any script, folded."""
    return F.filter(F.split(fold(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_terms(query: str) -> list[str]:
    """``terms`` of a search text, outside Spark."""
    low = (query or "").lower().translate(str.maketrans(ACCENTED[: len(UNACCENTED)], UNACCENTED, ACCENTED[len(UNACCENTED) :]))
    return re.findall(r"[^\W_]+", low)


def trim_text(text: Column, limit: int = 600) -> Column:
    """White space collapsed; cut to ``limit`` with dots where longer."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.rtrim(F.substring(flat, 1, limit - 3)), F.lit("..."))).otherwise(flat)


def preview(text: Column, limit: int) -> Column:
    return F.substring(text, 1, limit)


def short_location(path: Column, keep: int = 3) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) > keep, F.array_join(F.slice(parts, -keep, keep), "/")).otherwise(path)


def note_id(text: Column) -> Column:
    """``note-<n>`` or ``<n>`` as a number, else null."""
    return F.regexp_replace(text, "^note-", "").try_cast("long")


def note_kind(kind: Column) -> Column:
    tidy = F.trim(F.lower(kind))
    return F.coalesce(F.when(tidy != "", tidy), F.lit("fact"))


def note_title(title: Column, content: Column) -> Column:
    return F.coalesce(F.when(title != "", title), F.substring(content, 1, 80))


def new_priority(priority: Column) -> Column:
    """Priorities are matched as written, so ``High`` becomes medium."""
    return F.when(priority.isin(*PRIORITIES), priority).otherwise("medium")


def module_of(path: Column) -> Column:
    out = F.replace(path, F.lit("/"), F.lit("."))
    for suffix in (".py", ".lua", ".js"):
        out = F.replace(out, F.lit(suffix), F.lit(""))
    return out


def note_color(kind: Column) -> Column:
    out = None
    for k, v in NOTE_COLORS.items():
        out = F.when(kind == k, v) if out is None else out.when(kind == k, v)
    return out.otherwise(OTHER_COLOR)


def content_hash(data: Column) -> Column:
    return F.substring(F.sha2(data, 256), 1, 16)


def json_array(text: Column) -> Column:
    """A JSON array of strings; null, blank and malformed ones are empty."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def milli(inter: Column, union: Column) -> Column:
    """inter / union in thousandths, halves rounded up, in whole numbers."""
    return F.floor((2000 * inter + union) / (2 * union)).cast("long")
