"""Column expressions over text, in step with Python's notions of space, words and length."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"
#: ASCII punctuation, deleted before tokens are cut.
PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""
#: A stripped line that carries nothing: few signs, few letters beyond ASCII, a page number, a comment.
JUNK = r"(?U)^[\s\W]{0,3}$|^[^\x00-\x7F]{1,3}$|^\s*\d+\s*$|^<!--.*-->$"
#: Headings whose sections are left out.
SKIPPED = r"(?i)^(c\.\s*text samples?|text samples?|generated (text|samples?)|acknowledgements?|author contributions?|funding|competing interests?|ethics statement|supplementary (material|notes?|data))$"
FORMULA_TAG = "<!-- formula-not-decoded -->"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){SPACE}+\z", "")


def lines(c: Column) -> Column:
    """Array of lines: all of Python's line ends count, and no empty line follows the last."""
    unified = F.regexp_replace(c, "\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x85  ]", "\n")
    return F.split(F.regexp_replace(unified, r"\n\z", ""), "\n")


def tokens(c: Column) -> Column:
    """Lower case, punctuation deleted, cut at white space, tokens of one character dropped. Null has none."""
    plain = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), PUNCTUATION, "")
    return F.filter(F.split(plain, rf"(?U){SPACE}+"), lambda t: F.length(t) > 1)


def document_id(stem: Column) -> Column:
    return F.regexp_replace(stem, r"(?U)\W+", "_")


def chunk_id(doc: Column, index: Column, text: Column) -> Column:
    digest = F.substring(F.md5(F.concat(doc, F.lit(":"), index.cast("string"), F.lit(":"), F.substring(text, 1, 60))), 1, 8)
    return F.format_string("%s_%04d_%s", doc, index.cast("long"), digest)


def heading_prefix(path: Column) -> Column:
    return F.when(F.size(path) > 0, F.concat(F.array_join(path, " > "), F.lit("\n\n"))).otherwise("")


def has_table(c: Column) -> Column:
    return c.rlike(r"(?m)^\|.+\|")


def has_formula(c: Column) -> Column:
    return c.contains(FORMULA_TAG) | c.rlike(r"\$.+\$")


def has_code(c: Column) -> Column:
    return c.rlike("(?m)^```")


def joined_path(path: Column) -> Column:
    return F.array_join(path, " > ")


def split_path(joined: Column) -> Column:
    return F.filter(F.split(F.coalesce(joined, F.lit("")), " > "), lambda s: s != "")


def breadcrumb(path: Column, sep: str = " > ", otherwise: Column | str = "-") -> Column:
    return F.when(F.size(path) > 0, F.array_join(path, sep)).otherwise(otherwise)


def snippet(text: Column) -> Column:
    return F.concat(F.replace(F.substring(text, 1, 300), F.lit("\n"), F.lit(" ")), F.when(F.length(text) > 300, "…").otherwise(""))


def cut_answer(answer: Column) -> Column:
    return F.concat(F.substring(answer, 1, 300), F.lit("..."))


CUT_OFF = "The response was cut off before an answer was written. Please try again with a shorter question."


def after_thinking(c: Column) -> Column:
    return strip(F.substring_index(c, "</think>", -1))


def rewritten_query(draft: Column, question: Column) -> Column:
    """A drafted passage without its thoughts, or the question if the draft is shorter than 10 characters."""
    plain = strip(F.when(c_has(draft, "<think>") & c_has(draft, "</think>"), F.substring_index(draft, "</think>", -1)).otherwise(draft))
    return F.when(F.length(F.coalesce(plain, F.lit(""))) < 10, question).otherwise(plain)


def final_answer(raw: Column) -> Column:
    """An answer without its thoughts; a fixed message if they never end."""
    return F.when(~c_has(raw, "<think>"), strip(raw)).when(c_has(raw, "</think>"), after_thinking(raw)).otherwise(CUT_OFF)


def c_has(c: Column, part: str) -> Column:
    return F.coalesce(c.contains(part), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))


def bucket(token: Column, dims: int) -> Column:
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % dims


class Buckets(dict):
    """The bucket of each token, in step with bucket(), computed once, or again after MOST others."""

    MOST = 1 << 17

    def __init__(self, dims: int):
        self.dims = dims

    def __missing__(self, token: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        out = self[token] = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % self.dims
        return out
