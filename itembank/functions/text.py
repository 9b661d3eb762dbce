"""Scalar text functions, all of them Spark SQL expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accent_table() -> tuple[str, str]:
    """Accented letters up to U+024F and their base letters, from the Unicode database."""
    src, dst = [], []
    for c in map(chr, range(0x80, 0x250)):
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if len(base) == 1 and base != c:
            src.append(c)
            dst.append(base)
    return "".join(src), "".join(dst)


ACCENTED, PLAIN = _accent_table()


def fold(x: Column) -> Column:
    """Lower case without accents; sharp s is ss. Null stays null. Plain ASCII only needs lower case."""
    whole = F.regexp_replace(F.translate(F.replace(F.lower(x), F.lit("ß"), F.lit("ss")), ACCENTED, PLAIN), r"\p{Mn}+", "")
    return F.when(F.length(x) == F.octet_length(x), F.lower(x)).otherwise(whole)


def once(x: Column, f) -> Column:
    """``f(x)`` with ``x`` evaluated once, however often ``f`` uses it and wherever a filter on it is moved."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def fold_search(x: Column) -> Column:
    """Folding for searches: as :func:`fold`, but sharp s stays."""
    return F.regexp_replace(F.translate(F.lower(x), ACCENTED, PLAIN), r"\p{Mn}+", "")


def signature(x: Column, profile: str = "pdf") -> Column:
    """Letters, digits and underscores of the folded text; profile ``txt`` keeps the first 160."""
    return signature_of(fold(x), profile)


def signature_of(folded: Column, profile: str = "pdf") -> Column:
    """:func:`signature` of a text that is folded already."""
    s = F.regexp_replace(folded, r"[^\p{L}\p{N}_]+", "")
    return F.substring(s, 1, 160) if profile == "txt" else s


def clean(x: Column) -> Column:
    """Without soft hyphens and ligatures, white space collapsed, dashes and blanks trimmed off."""
    y = F.replace(F.replace(F.replace(x, F.lit("­"), F.lit("")), F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    return F.regexp_replace(F.regexp_replace(y, r"[\s ]+", " "), "^[ \\-–]+|[ \\-–]+$", "")


#: A page reference, what begins the footer before it, a block's name that may follow
#: it, a word, how far back a footer reaches, and what is trimmed off the end.
PAGE_REFERENCE = r"\bp[aá]gina\s+\d+\s+de\s+\d+\b"
FOOTER_ANCHOR = r"ejercicio\s+[uú]nico|[12]\s*[-.]\s*(?:test|cp)|20\d{2}\s*[-—–].{0,24}?tai"
BLOCK_NAME, A_WORD, LOOK_BACK, TRAILING = r"\bbloque\s+[ivx]+\b", "[a-záéíóúñ]{3,}", 110, r"[ \t\n\r|,:;*\-—–\[\]()€]+$"


def without_footer(x: Column) -> Column:
    """White space collapsed, and a closing page footer cut off.

    The last page reference is a footer's if no word of three letters follows it but a block's name.
    The cut is at the first anchor in the 110 characters before it, and else at the reference. A
    reference that more text follows stays, for the quality rules to see.
    """
    v = F.trim(F.regexp_replace(x, r"[\s\p{Z}]+", " "))
    parts = rf"(?isu)^(.*)({PAGE_REFERENCE})(.*?)$"
    head, tail = F.regexp_extract(v, parts, 1), F.regexp_extract(v, parts, 3)
    goes_on = F.regexp_replace(tail, f"(?iu){BLOCK_NAME}", "").rlike(f"(?iu){A_WORD}")
    window = F.right(head, F.lit(LOOK_BACK))
    at = F.regexp_instr(window, F.lit(f"(?iu)(?:{FOOTER_ANCHOR})"))
    kept = F.when(at > 0, head.substr(F.lit(1), F.length(head) - F.length(window) + at - 1)).otherwise(head)
    return F.when(~v.rlike(f"(?iu){PAGE_REFERENCE}") | goes_on, v).otherwise(F.regexp_replace(kept, TRAILING, ""))


def page_of_offset(text: Column, offset: Column, mark: str = "\f") -> Column:
    """Page of a 0-based offset: page marks before it, plus one."""
    return (F.length(text.substr(F.lit(1), offset)) - F.length(F.replace(text.substr(F.lit(1), offset), F.lit(mark), F.lit(""))) + 1).cast("long")


def strip_noise_lines(x: Column, noise: str = r"^\s*(?:-?\s*\d+\s*-?|page \d+.*|https?://\S+)\s*$") -> Column:
    """Lines that are page numbers or bare addresses are dropped."""
    return F.array_join(F.filter(F.split(x, "\n", -1), lambda line: ~F.lower(line).rlike(noise)), "\n")


def option_letter(i: Column) -> Column:
    """0-based option number as a letter."""
    return F.char(97 + i)


def option_text(options: Column, letter: Column) -> Column:
    """The option a letter stands for; null where there is none."""
    return F.try_element_at(options, (F.ascii(letter) - 96).cast("int"))


def number_es(x: Column) -> Column:
    """Two decimals, comma, points only from five digits before it."""
    s = F.format_string("%.2f", x)
    whole, frac = F.split_part(s, F.lit("."), F.lit(1)), F.split_part(s, F.lit("."), F.lit(2))
    grouped = F.regexp_replace(whole, r"(?<=\d)(?=(\d{3})+$)", ".")
    return F.concat(F.when(F.length(F.regexp_replace(whole, "-", "")) >= 5, grouped).otherwise(whole), F.lit(","), frac)


def mmss(seconds: Column) -> Column:
    return F.format_string("%02d:%02d", (seconds / 60).cast("long"), (seconds % 60).cast("long"))


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def year_of(x: Column) -> Column:
    """The first year from 2000 on in a text; null where there is none."""
    return F.nullif(F.regexp_extract(x, r"20\d{2}", 0), F.lit("")).try_cast("int")


def date_es(x: Column) -> Column:
    """Day, month and year without leading zeros."""
    return F.date_format(x, "d/M/yyyy")


def block_of(topic: Column) -> Column:
    return F.split_part(topic, F.lit("."), F.lit(1))


def normal_answer(x: Column) -> Column:
    """An answer in lower case; null stays null."""
    return F.lower(F.trim(x))


def document_id(path: Column) -> Column:
    return F.substring(F.sha1(path), 1, 12)


def cache_key(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def seeded_order(seed: str, *key: str) -> list[Column]:
    """A reproducible shuffle: order by the hash of seed and key, then by the key."""
    return [F.md5(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in key])), *[F.col(k) for k in key]]
