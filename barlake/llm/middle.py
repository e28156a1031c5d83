"""Fill-in-the-middle transformation with content-defined chunks.

A text's units are maximal runs of ASCII letters and, each by itself, all other code points. Two
hashed unit counts cut it into prefix, middle and suffix. Units are not listed: a rolling hash
of the last 32 code points cuts the text into chunks wherever its top bits are zero, so texts
that share a passage share its chunks. A chunk's boundary summary (units if it stood alone,
letter at its start, letter at its end) is kept by content: the dictionary compares the whole
chunk, so a shared one is never mistaken. Summaries combine associatively: units add up, less
one where a run of letters goes over a border. Their prefix sums name the chunk of a cut, and
only that chunk (and a run that goes on from it) is looked into.

Null and empty texts are plain, with 0 units. Rows stand for themselves: repeated or null ids
are fine (a null id hashes as the empty string), row order does not matter, an empty table gives
an empty one. One pass, no shuffle; a worker holds one Arrow batch, and at most ``CACHED``
characters of chunks.
"""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.llm.arrow import computed

PLAIN_PERCENT, SPM_PERCENT = 10, 20
MARKS = re.compile("<[PSM]>")
UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")
RUN = re.compile("[A-Za-z]+")
BITS = 7  # top bits of the rolling hash that are zero at a border: 128 characters on average
LONGEST = 1 << 12  # a chunk without a border is cut here
CACHED = 1 << 25  # characters of chunks kept before the dictionary starts anew

Summary = tuple[int, bool, bool]


def rolling(codes: np.ndarray) -> np.ndarray:
    """Gear hash of the last 32 code points at each place: sums of mixed values, each shifted by
    its distance, built by doubling."""
    h = codes * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    for reach in (1, 2, 4, 8, 16):
        h[reach:] += h[:-reach] << np.uint32(reach)
    return h


def borders(text: str) -> np.ndarray:
    """Ends of the text's chunks."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    ends = np.flatnonzero(rolling(codes) >> np.uint32(32 - BITS) == 0) + 1
    ends = np.append(ends[ends < len(codes)], len(codes))
    gaps = np.diff(ends, prepend=0)
    if (gaps > LONGEST).any():
        more = [np.arange(e - g + LONGEST, e, LONGEST) for e, g in
                zip(ends[gaps > LONGEST], gaps[gaps > LONGEST], strict=True)]
        ends = np.sort(np.concatenate([ends, *more]))
    return ends


def summary(chunk: str) -> Summary:
    return (len(RUN.sub("a", chunk)), RUN.match(chunk) is not None,
            chunk[-1].isascii() and chunk[-1].isalpha())


class Cutter:
    """Units of texts and the places of cuts, with chunk summaries kept by content."""

    def __init__(self) -> None:
        self.known: dict[str, Summary] = {}
        self.held = 0

    def summaries(self, chunks: list[str]) -> np.ndarray:
        if self.held > CACHED:
            self.known, self.held = {}, 0
        known = self.known
        for c in chunks:
            if c not in known:
                known[c] = summary(c)
                self.held += len(c)
        return np.array([known[c] for c in chunks], dtype=np.int64)

    def measured(self, text: str) -> Measured:
        if not text:
            return Measured([], np.zeros(0, np.int64), np.zeros((0, 3), np.int64))
        ends = borders(text)
        starts = [0, *ends[:-1].tolist()]
        chunks = [text[a:b] for a, b in zip(starts, ends.tolist(), strict=True)]
        return Measured(chunks, ends, self.summaries(chunks))


class Measured:
    """A text's chunks with their combined summaries."""

    def __init__(self, chunks: list[str], ends: np.ndarray, sums: np.ndarray):
        self.chunks, self.sums = chunks, sums
        self.starts = ends - np.array([len(c) for c in chunks], dtype=np.int64)
        # A chunk goes on with the unit before it if letters meet at its start.
        self.goes_on = np.zeros(len(chunks), dtype=np.int64)
        self.goes_on[1:] = sums[1:, 1] & sums[:-1, 2]
        self.upto = np.cumsum(sums[:, 0] - self.goes_on)
        self.n = int(self.upto[-1]) if len(chunks) else 0

    def place(self, units: int) -> int:
        """Code points in the first ``units`` units."""
        if not units:
            return 0
        j = int(np.searchsorted(self.upto, units, side="left"))
        before = int(self.upto[j - 1]) if j else 0
        local = units - before + int(self.goes_on[j])
        end = next(islice(UNIT.finditer(self.chunks[j]), local - 1, None)).end()
        while end == len(self.chunks[j]) and j + 1 < len(self.chunks) and self.goes_on[j + 1]:
            j += 1
            end = RUN.match(self.chunks[j]).end()
        return int(self.starts[j]) + end


def hashed(id: str | Column, part: int) -> Column:
    """The ``part``-th group of eight hex digits of sha256('1:' and the id), as a number."""
    key = F.coalesce((F.col(id) if isinstance(id, str) else id).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit("1:"), key), 256)
    return F.conv(F.substring(digest, 8 * part - 7, 8), 16, 10).cast("bigint")


def transformed(docs: DataFrame, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT,
                id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and
    output, the rearranged text."""
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"),
                       *[hashed(id, k).alias(f"h{k}") for k in (1, 2, 3, 4)])

    def make():
        cutter = Cutter()

        def compute(batch: pa.RecordBatch) -> tuple:
            out = []
            h = [batch.column(f"h{k}").to_pylist() for k in (1, 2, 3, 4)]
            for t, h1, h2, h3, h4 in zip(batch.column("text").to_pylist(), *h, strict=True):
                t = t or ""
                m = cutter.measured(t)
                if not t or h3 % 100 >= 100 - plain_percent or MARKS.search(t):
                    out.append((m.n, "plain", None, None, t))
                    continue
                a, b = (m.place(k) for k in sorted((h1 % (m.n + 1), h2 % (m.n + 1))))
                first, middle, rest = t[:a], t[a:b], t[b:]
                if h4 % 100 < spm_percent:
                    made = ("spm", a, b - a, f"<S>{rest}<P>{first}<M>{middle}")
                else:
                    made = ("psm", a, b - a, f"<P>{first}<S>{rest}<M>{middle}")
                out.append((m.n, *made))
            return tuple(zip(*out, strict=True)) if out else ([],) * 5

        return compute

    return computed(rows, ["doc_id"], "n bigint, form string, prefix_chars bigint, "
                                      "middle_chars bigint, output string", make)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that ``transformed`` rearranged, from output and form alone.

    Texts with marks are plain, and a mark cannot begin inside another or inside what stands
    before it, so the first of each is the one that was set.
    """
    def parts(mark: str) -> tuple[Column, Column, Column]:
        o = F.col(output)
        two, three = F.locate(mark, o), F.locate("<M>", o)
        return (F.substr(o, F.lit(4), two - 4), F.substr(o, two + 3, three - two - 3),
                F.substr(o, three + 3))

    head, rest, middle = parts("<S>")
    rest_first, head_second, middle_last = parts("<P>")
    return (F.when(F.col(form) == "psm", F.concat(head, middle, rest))
            .when(F.col(form) == "spm", F.concat(head_second, middle_last, rest_first))
            .otherwise(F.col(output)))
