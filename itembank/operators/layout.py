"""Questions from the coordinates of recognised words, and their alignment to a questionnaire's plan.

A document is one row with its pages nested, as layouts are stored, so nothing is shuffled: a helper
inside ``mapInArrow`` marks and reads the words of one document at a time. Only the alignment groups
rows, by questionnaire, whose questions are a few hundred.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import lru_cache
from itertools import compress, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itembank.functions import workers
from itembank.operators import ocr

PAGES = "array<struct<page:int,width:double,height:double,lines:array<struct<top:double,text:string,words:array<struct<left:double,top:double,text:string>>>>>>"

#: The band of question numbers and of content by share of the page, option markers.
BAND_LEFT, BAND_RIGHT, TOP, BOTTOM = 0.03, 0.072, 0.025, 0.98
_MARK = r"(?:[a-dA-DOo]|ce|CE|Cc|CC|cl|CL|od|0d|OD|€|£|<|¢|e|E|ç|[1-4])\s*"
MARKER, CLEAR_MARKER = re.compile(_MARK + r"[.)/]?"), re.compile(_MARK + r"[.)/]")
NUMBER, LETTER, WORDY = re.compile(r"\d{1,3}"), re.compile("[a-dA-D]"), re.compile("[A-Za-zÁÉÍÓÚáéíóúÑñ]{2,}")
GOOD, SHORTEST_LINE, STARTS_OF_CONTENT, QUESTIONS_OF_CONTENT, MOST_BEFORE_ONE = 4, 7, 2, 5, 3
SMALL_SECTION, FILLED_SHARE = 5, 0.65

#: So many documents' words are read at once.
DOCS_AT_ONCE = 64


@dataclass
class Word:
    page: int
    text: str
    shown: bool
    head: bool
    banded: bool
    start: bool = False
    option: bool = False


@dataclass
class Words:
    """All words of a document in order, as columns; the flags are those of :class:`Word`."""

    pages: list[int]
    page_at: np.ndarray  # of each word, its place in pages
    texts: list[str]
    flags: dict[str, np.ndarray]

    def page(self, i: int) -> int:
        return self.pages[self.page_at[i]]


FLAGS = ["shown", "head", "banded", "start", "option"]
_MARKS, _MARKS_CLEARLY, _LETTER, _NUMBER, _WORDY = 1, 2, 4, 8, 16


@lru_cache(1 << 16)
def _read(text: str) -> tuple[str, int]:
    """A word's text without white space around it, and what the text alone tells."""
    text = text.strip()
    if len(text) > 2 and text.isascii() and text.isalpha():  # no mark is a longer word
        return text, _WORDY
    told = _MARKS * bool(MARKER.fullmatch(text)) | _MARKS_CLEARLY * bool(CLEAR_MARKER.fullmatch(text)) | _LETTER * bool(LETTER.fullmatch(text))
    return text, told | _NUMBER * bool(NUMBER.fullmatch(text.rstrip(".),;:"))) | _WORDY * bool(WORDY.search(text))


def nested(column: pa.Array):
    """The :class:`Words` of each row of pages, marked: ``shown`` (inside the page's height), ``head``
    (first of its line), ``banded`` (where numbers stand), ``start``, ``option``.

    Lines outside the page's height are left out; a missing coordinate is outside of everything. Marks
    are made for whole columns, and texts looked at once for each that differs.
    """

    def inner(lists: pa.Array, fields: list[str]) -> list:
        flat = workers.flat(lists)
        return [pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), *[pc.struct_field(flat, f) for f in fields]]

    numbers = lambda x, missing: pc.fill_null(x, missing).to_numpy(zero_copy_only=False)
    pages, no, width, height, lines = inner(column, ["page", "width", "height", "lines"])
    rows, row_top, row_text, words = inner(lines, ["top", "text", "words"])
    sizes, left, top, text = inner(words, ["left", "top", "text"])
    width, height = (np.fmax(1.0, numbers(x, 0.0)) for x in (width, height))
    inside = lambda top, height: (height * TOP <= top) & (top <= height * BOTTOM)
    page_of_line = np.repeat(np.arange(len(rows)), rows)
    kept = (sizes > 0) & inside(numbers(row_top, np.nan), height[page_of_line])
    of_word = np.repeat(kept, sizes)
    left, top = (numbers(x, missing)[of_word] for x, missing in ((left, -1.0), (top, np.nan)))
    coded = pc.fill_null(text, "").dictionary_encode()
    known = [_read(t) for t in coded.dictionary.to_numpy(zero_copy_only=False)]  # to_pylist takes ten times as long
    codes = coded.indices.to_numpy()[of_word]
    texts = np.array([t for t, _ in known], object)[codes].tolist()
    told = np.array([x for _, x in known], np.uint8)[codes]
    short = numbers(pc.utf8_length(row_text), 0)[kept] < SHORTEST_LINE  # a short line starts nothing
    sizes, page_of_line = sizes[kept], page_of_line[kept]
    line, page = np.repeat(np.arange(len(sizes)), sizes), np.repeat(page_of_line, sizes)
    at, firsts = np.arange(len(line)), np.cumsum(sizes) - sizes
    first = lambda flag: np.minimum.reduceat(np.where(flag, at, len(at)), firsts) if len(firsts) else firsts
    has = lambda what: (told & what) > 0
    head, start = np.zeros((2, len(at)), bool)
    head[firsts] = True
    right = left >= (width * BAND_RIGHT)[page]
    banded = ((width * BAND_LEFT)[page] <= left) & ~right
    numbered = first(banded & has(_NUMBER) & ~short[line] & (at < first(right)[line]))
    start[numbered[numbered < len(at)]] = True
    option = right & np.where(head, has(_MARKS), has(_MARKS_CLEARLY) | (has(_LETTER) & (first(has(_WORDY))[line] >= at)))
    flags = dict(zip(FLAGS, (inside(top, height[page]), head, banded, start, option), strict=True))
    nos, first_page = no.to_pylist(), np.concatenate([[0], np.cumsum(pages)])
    cuts = np.searchsorted(page, first_page)
    for a, b, lo, hi in zip(first_page[:-1].tolist(), first_page[1:].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield Words(nos[a:b], page[lo:hi] - a, texts[lo:hi], {k: x[lo:hi] for k, x in flags.items()})


def marked_words(words: Words) -> list[Word]:
    """A document's words one by one."""
    return [Word(words.page(i), t, *flags) for i, (t, *flags) in enumerate(zip(words.texts, *[words.flags[f].tolist() for f in FLAGS], strict=True))]


@dataclass
class Found(ocr.Question):
    inferred: bool = False


class Sheet:
    """One document's marked words."""

    def __init__(self, words: Words):
        self.page = words.page
        starts, options, self.heads, self.indents = (np.flatnonzero(x).tolist() for x in (words.flags["start"], words.flags["option"], words.flags["head"], words.flags["head"] & words.flags["banded"]))
        self.first = first_page([self.page(i) for i in starts], STARTS_OF_CONTENT, self.page(0) if words.texts else 1)
        self.starts, self.options = ([i for i in x if self.page(i) >= self.first] for x in (starts, options))
        self.numbers = [ocr.number(words.texts[i]) for i in self.starts]
        self.labels = [ocr.label(words.texts[i]) for i in self.options]
        # a stretch's shown words are a stretch of all shown ones
        self.shown = list(compress(words.texts, words.flags["shown"]))
        self.before = [0, *np.cumsum(words.flags["shown"]).tolist()]

    def marks(self, lo: int, hi: int) -> tuple[list[int], list[str]]:
        mine = slice(bisect_left(self.options, lo), bisect_left(self.options, hi))
        return self.options[mine], self.labels[mine]

    def runs(self, lo: int, hi: int) -> list[list[int]]:
        some, labels = self.marks(lo, hi)
        return [[some[i] for i in run] for run in ocr.runs_of_four(labels)]

    def text(self, lo: int, hi: int) -> str:
        return ocr.tidy(" ".join(self.shown[self.before[lo] : self.before[hi]]))

    def question(self, number: int, start: int, four: list[int], end: int, segment: int, inferred: bool) -> list[Found]:
        """The question, or nothing if its prompt or an option is empty."""
        parts = [self.text(a + 1, b) for a, b in zip([start, *four], [*four, end], strict=True)]
        return [Found(segment, number, parts[0], parts[1:], self.page(start), start, inferred)] if all(parts) else []

    def unnumbered(self, runs: list[list[int]], floor: int, number: int, end: int, segment: int) -> list[Found]:
        """Questions of runs of options, numbered from ``number`` on. Each starts at the last indented line
        between the run before it (the first: ``floor``) and its own; without such a line it is none."""
        out = []
        for k, run in enumerate(runs):
            i = bisect_left(self.indents, run[0]) - 1
            if i >= 0 and self.indents[i] > floor:
                out += self.question(number + k, self.indents[i], run, end, segment, True)
            floor = run[-1]
        return out


def first_page(pages: list[int], least: int, otherwise: int) -> int:
    """The first page that occurs ``least`` times."""
    return min((p for p, n in Counter(pages).items() if n >= least), default=otherwise)


def falls(number: int, last: int) -> bool:
    """Whether a number starts a new segment after ``last`` (0: there was none)."""
    return bool(last) and number <= last and (number <= 5 or number < last - 10)


def questions_of(words: Words) -> list[Found]:
    """The questions of marked words: those with a readable number, each read by itself, then those that
    gaps in the numbers and surplus runs of options give away."""
    sheet = Sheet(words)
    ends, after = [*sheet.starts, len(words.texts)][1:], [*sheet.numbers, None][1:]
    read: list[Found] = []
    hidden: list[Found] = []
    segment = of_gap = 1
    last = last_start = 0
    for at, end, n, following in zip(sheet.starts, ends, sheet.numbers, after, strict=True):
        of_gap += falls(n, last_start)
        last_start = n
        if following is not None and following > n + 1 and (runs := sheet.runs(at + 1, end)):
            hidden += sheet.unnumbered(runs[1 : following - n], runs[0][-1], n + 1, end, of_gap)
        some, labels = sheet.marks(at + 1, end)
        score, four = ocr.align(labels)
        if score >= GOOD and four:
            segment += falls(n, last)
            last = n
            read += sheet.question(n, at, [some[i] for i in four], end, segment, False)
    if sheet.starts and sheet.numbers[0] > 1:
        hidden += sheet.unnumbered(sheet.runs(0, sheet.starts[0])[1 - sheet.numbers[0] :], -1, 1, sheet.starts[0], 1)
    have = {(q.segment, q.number) for q in read}
    rows = in_order(read + [q for q in hidden if (q.segment, q.number) not in have])
    page = first_page([q.page for q in rows], QUESTIONS_OF_CONTENT, sheet.first)
    rows = [q for q in rows if q.page >= page and not plain(q.prompt).startswith(ocr.INSTRUCTIONS)]
    if rows and rows[0].number > 1:
        top = next((i for i in sheet.heads if words.page(i) == page), 0)
        runs = sheet.runs(top, rows[0].order)[1 - rows[0].number :]
        rows = in_order(rows + sheet.unnumbered(runs, top - 1, 1, rows[0].order, 1))
    one = next((i for i, q in enumerate(rows) if q.number == 1), None)
    return ocr.repaired(rows[one:] if one is not None and one <= MOST_BEFORE_ONE else rows)


def in_order(rows: list[Found]) -> list[Found]:
    return sorted(rows, key=lambda q: (q.page, q.order))


def plain(text: str) -> str:
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFD", text.casefold()) if unicodedata.category(c) != "Mn")


def layout_questions(docs: DataFrame, key: str = "doc_id", pages: str = "pages") -> DataFrame:
    """``key`` and the questions of every document's layout (``pages``, of type :data:`PAGES`), in place.

    ``inferred`` tells whether a question's number was unreadable. A document without pages, or
    whose pages are null or have no words, has no questions; null words are empty ones.
    """
    workers.ready(docs.sparkSession)
    kinds = {"segment": pa.int32(), "number": pa.int32(), "prompt": pa.string(), "options": pa.list_(pa.string()), "page": pa.int32(), "order": pa.int32(), "inferred": pa.bool_()}

    def run(batches):
        for b in workers.slices(batches, DOCS_AT_ONCE):
            at, rows = [], []
            for i, words in enumerate(nested(b.column(1))):
                found = questions_of(words)
                at += [i] * len(found)
                rows += found
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *[pa.array([getattr(q, n) for q in rows], k) for n, k in kinds.items()]], names=[key, *kinds])

    return docs.select(key, pages).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, {ocr.FOUND}, inferred boolean")


def longest_common(observed: list[int], expected: list[int]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence; of equals the one found from the end that leaves out
    observed numbers before expected ones, but takes a match where it can."""
    n = len(expected)
    places: dict[int, int] = defaultdict(int)
    for j, x in enumerate(expected):
        places[x] |= 1 << j
    # a row of the table of lengths as a number: bit j is set where the length grows at j
    grows, row, every = [0], 0, (1 << n) - 1
    for x in observed:
        still = every & ~row
        hit = still & places.get(x, 0)
        row = every & ~((still + hit) | (still & ~hit))
        grows.append(row)
    pairs, i, j = [], len(observed), n
    while i and j:
        up, here, left = grows[i - 1], grows[i], (1 << (j - 1)) - 1
        before = (here & left).bit_count()
        if observed[i - 1] == expected[j - 1] and before + (here >> (j - 1) & 1) == (up & left).bit_count() + 1:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif (up & (left << 1 | 1)).bit_count() >= before:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


def placed(items: list[tuple[int, int]], specs: list[tuple[str, int]]) -> list[tuple[str, int, int | None, str]]:
    """``(section, number, index of the item or None, how)`` for every place of the plan.

    ``items`` are (number, segment) in printed order. Places that the alignment leaves open are filled
    from segments: each section takes the next one, and more as long as a large section's highest
    number stays under 65 %; of equal numbers the first.
    """
    grid = [(s, n) for s, count in specs for n in range(1, count + 1)]
    got = {grid[j]: (i, "aligned") for i, j in longest_common([n for n, _ in items], [n for _, n in grid])}
    order = sorted(range(len(items)), key=lambda i: items[i][1])
    groups = [list(g) for _, g in groupby(order, key=lambda i: items[i][1])][::-1]
    for section, count in specs:
        mine = groups.pop() if groups else []
        top = max((items[i][0] for i in mine), default=0)
        while groups and mine and count > SMALL_SECTION and top < count * FILLED_SHARE:
            top = max(top, *(items[i][0] for i in groups[-1]))
            mine += groups.pop()
        for i in mine:
            if 1 <= items[i][0] <= count:
                got.setdefault((section, items[i][0]), (i, "segment"))
    return [(*place, *got.get(place, (None, "missing"))) for place in grid]


def aligned(items: DataFrame, specs: list[tuple[str, int]], key: str | list[str], ref: str) -> DataFrame:
    """``key``, ``section``, ``number``, ``ref``, ``how`` for every questionnaire and place of its plan.

    ``items`` has ``page``, ``order``, ``number``, ``segment`` and ``ref``, which tells an item; ties
    of page and order follow ``ref``. ``ref`` is null and ``how`` is missing where no item fits.
    Items without a number fit nowhere; a questionnaire without any items isn't there. What ``ref``
    holds passes through the worker as it is; only numbers and segments are looked at.
    """
    workers.ready(items.sparkSession)
    keys = [key] if isinstance(key, str) else list(key)
    rows = F.array_sort(F.collect_list(F.struct("page", "order", F.col(ref).alias("ref"), F.coalesce("number", F.lit(0)).alias("number"), F.coalesce("segment", F.lit(0)).alias("segment"))))
    kind = items.schema[ref].dataType

    def run(batches):
        for b in workers.slices(batches):
            lists = b.column(len(keys))
            flat, sizes = lists.flatten(), pc.list_value_length(lists).to_pylist()
            said, segments = (pc.struct_field(flat, c).to_pylist() for c in ("number", "segment"))
            at, taken, out, lo = [], [], [], 0
            for i, n in enumerate(sizes):
                mine = placed(list(zip(said[lo : lo + n], segments[lo : lo + n], strict=True)), specs)
                at += [i] * len(mine)
                taken += [None if k is None else lo + k for _, _, k, _ in mine]
                out += mine
                lo += n
            section, number, _, how = zip(*out, strict=True) if out else [()] * 4
            refs = pc.struct_field(flat, "ref").take(pa.array(taken, pa.int64()))
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(pa.array(at, pa.int64())) for k in range(len(keys))], pa.array(section, pa.string()), pa.array(number, pa.int32()), refs, pa.array(how, pa.string())], names=[*keys, "section", "number", ref, "how"])

    of = ", ".join(f"{k} {items.schema[k].dataType.simpleString()}" for k in keys)
    return items.groupBy(*keys).agg(rows.alias("rows")).mapInArrow(run, f"{of}, section string, number int, {ref} {kind.simpleString()}, how string")
