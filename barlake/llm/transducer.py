"""Token counts by a deterministic finite-state transducer compiled from a BPE vocabulary.

A sequence of tokens is the encoding of its text exactly if each two neighbours are the encoding
of theirs. So the encoding of every prefix of a text ends in one token, which follows from the
last tokens of the shorter prefixes at which a token that is still open may begin. The state after
a character holds those: the open suffix (the longest end of the text that begins some token),
and for each place in it the last token before and its count against the count now. Reading
a character leads to one next state and emits a number of tokens, which is negative where a longer
token takes the place of several. States and transitions are made when first asked for, then
looked up.

Texts are cut into chunks. A space after another character, and a line break that no token holds,
put every state into the same one, so a chunk between such borders has a constant state map:
its count, whatever came before. A longer stretch is cut every ``PIECE`` characters; a piece's map
sends the state that enters it to the one that leaves it and a count. Maps are kept by content, and
compose associatively; prefix sums of chunk counts give the token offset of every chunk.

Tokens of spaces alone come last in the merge order, so a run of spaces is counted after the chunk
that follows it has taken the last one (or not).

Null texts count as empty ones, with no tokens. Rows stand for themselves: ids may repeat or be
null, row order does not matter, an empty table gives an empty one. One pass, no shuffle; a worker
holds one Arrow batch and bounded dictionaries.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from barlake.llm.arrow import computed

SPACE = "▁"
PIECE = 64
LIMIT = 4096
CACHED_CHUNKS = 300_000  # chunk maps and
CACHED_STATES = 150_000  # states of the transducer kept before either starts anew
PROBE = "a  b　ﬁÅÅ \t\n"  # changed by any other than the supported normalization

State = tuple[str, tuple[tuple[int, str, int], ...]]
ANY = ""  # a last token that goes with every next one


def merged(symbols: Iterable[str], score: dict[str, float]) -> list[str]:
    """Byte-pair encoding: the best scored neighbours first, the leftmost of equals."""
    s: list[str] = list(symbols)
    after = [*range(1, len(s)), -1]
    before = [*range(-1, len(s) - 1)]
    heap: list[tuple[float, int, int, str]] = []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j >= 0 and (worth := score.get(s[i] + s[j])) is not None:
            heapq.heappush(heap, (-worth, i, j, s[i] + s[j]))

    for i in range(len(s) - 1):
        offer(i, i + 1)
    while heap:
        _, i, j, both = heapq.heappop(heap)
        if s[i] and s[j] and after[i] == j and s[i] + s[j] == both:
            s[i], s[j], after[i] = both, "", after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
    return [x for x in s if x]


class Transducer:
    """Counts of the tokens that a sentencepiece BPE model with byte fallback gives."""

    START: State = ("", ((0, ANY, 0),))

    def __init__(self, model: str):
        library = SentencePieceProcessor(model_file=model)
        if library.normalize(PROBE) != SPACE + PROBE.replace(" ", SPACE):
            raise ValueError("only models that do nothing but mark spaces and add one in front")
        ids = range(library.get_piece_size())
        odd = [i for i in ids if library.is_unused(i)]
        special = [i for i in ids if library.is_byte(i) or library.is_control(i) or library.is_unknown(i)]
        if odd or sum(library.is_byte(i) for i in ids) != 256:
            raise ValueError("a model with byte fallback and without unused tokens is needed")
        dropped = set(special)
        score = {library.id_to_piece(i): library.get_score(i) for i in ids if i not in dropped}
        self.spaces = {t: w for t, w in score.items() if not t.strip(SPACE) and len(t) > 1}
        self.score = {t: w for t, w in score.items() if t not in self.spaces}
        if any(SPACE in t[1:] for t in self.score) or max(self.spaces.values(), default=-np.inf) > min(
                w for t, w in self.score.items() if len(t) > 1):
            raise ValueError("a token with a space inside, or of spaces before others")
        self.begins = {t[:k] for t in self.score for k in range(1, len(t))}
        self.breaks = "\n" if not any("\n" in t for t in self.score) else ""
        self.cut = re.compile(f"{SPACE}*[^{SPACE}{self.breaks}]+|{SPACE}+" + ("|\n" if self.breaks else ""))
        self.fits: dict[tuple[str, str], bool] = {}
        self.runs: dict[int, int] = {}
        self.known: dict[str, int] = {}
        self.renew()

    def renew(self) -> None:
        self.numbers: dict[State, int] = {self.START: 0}
        self.states: list[State] = [self.START]
        self.next: list[dict[str, tuple[int, int]]] = [{}]
        self.maps: dict[tuple[int, str], tuple[int, int]] = {}

    def worth(self, token: str) -> int:
        """Tokens written for one symbol: itself, or its bytes."""
        return 1 if token in self.score else len(token.encode("utf-8", "surrogatepass"))

    def follows(self, last: str, token: str) -> bool:
        """Whether the encoding of both texts together is the two of them."""
        got = self.fits.get((last, token))
        if got is None:
            want = [last, token] if last else [token]
            got = self.fits[last, token] = merged(last + token, self.score) == want
            if len(self.fits) > 4 * CACHED_STATES:
                self.fits = {}
        return got

    def step(self, number: int, c: str) -> tuple[int, int]:
        """Next state and emitted tokens."""
        open_, places = self.states[number]
        kept, last, count = [], ANY, None
        for length, before, behind in places:
            text = open_[len(open_) - length:] + c
            if text in self.begins:
                kept.append((length + 1, before, behind))
            if (not length or text in self.score) and count is None and self.follows(before, text):
                last, count = text, behind + self.worth(text)
        if count is None:
            raise AssertionError("a prefix without an encoding")
        places = (*[(n, t, b - count) for n, t, b in kept], (0, last, 0))
        state = ((open_ + c)[len(open_) + 1 - places[0][0]:], places)
        to = self.numbers.get(state)
        if to is None:
            to = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.next.append({})
        self.next[number][c] = to, count
        return to, count

    def map(self, state: int, piece: str) -> tuple[int, int]:
        """State that leaves a piece entered in ``state``, and tokens emitted on the way."""
        total, known = 0, self.next
        for c in piece:
            state, emitted = known[state].get(c) or self.step(state, c)
            total += emitted
        return state, total

    def run(self, n: int) -> int:
        """Tokens of ``n`` spaces that no other token takes."""
        if n not in self.runs:
            self.runs[n] = len(merged(SPACE * n, self.spaces))
        return self.runs[n]

    def chunk(self, chunk: str) -> int:
        """Tokens of a chunk between two borders."""
        body = chunk.lstrip(SPACE)
        lead = len(chunk) - len(body)
        if not body:
            return self.run(lead)
        state, total = 0, 0
        if lead:
            state, total = self.map(0, SPACE + body[:1])
            body = body[1:]
        if len(body) <= PIECE:
            total += self.map(state, body)[1]
        else:
            for k in range(0, len(body), PIECE):
                entered = state, body[k:k + PIECE]
                if entered not in self.maps:
                    self.maps[entered] = self.map(*entered)
                state, emitted = self.maps[entered]
                total += emitted
        if lead > 1:
            alone = self.first(chunk.lstrip(SPACE)) == SPACE
            total += self.run(lead) - 1 if alone else self.run(lead - 1)
        return total

    def first(self, body: str) -> str:
        """First token of a space and ``body``."""
        return merged(SPACE + body, self.score)[0]

    def chunks(self, text: str) -> list[str]:
        return self.cut.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def counts(self, chunks: list[str]) -> np.ndarray:
        """Tokens of each chunk."""
        if len(self.known) > CACHED_CHUNKS:
            self.known = {}
        if len(self.states) + len(self.maps) > CACHED_STATES:
            self.renew()
        known = self.known
        for c in set(chunks).difference(known):
            known[c] = self.chunk(c)
        return np.fromiter(map(known.__getitem__, chunks), dtype=np.int64, count=len(chunks))

    def count(self, text: str | None) -> int:
        return int(self.counts(self.chunks(text or "")).sum())

    def offsets(self, text: str | None) -> np.ndarray:
        """Tokens before each chunk and, last, in all of the text."""
        return np.concatenate([[0], np.cumsum(self.counts(self.chunks(text or "")))])


@lru_cache(maxsize=2)
def transducer(model: str) -> Transducer:
    """One transducer for each model file and Python worker."""
    return Transducer(model)


def counted(docs: DataFrame, model: str, limit: int = LIMIT, id: str = "doc_id",
            text: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id).alias("doc_id"), whole.alias("text"),
                       F.octet_length(whole).cast("bigint").alias("n_bytes"))

    def make():
        t = transducer(model)

        def compute(batch: pa.RecordBatch) -> tuple:
            return ([t.count(x) for x in batch.column("text").to_pylist()],)

        return compute

    return computed(rows, ["doc_id", "n_bytes"], "n_tokens bigint", make).withColumn(
        "over_limit", F.col("n_tokens") > limit)


def chunk_offsets(docs: DataFrame, model: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, chunks (the text, spaces marked, cut at its borders) and offsets: the tokens before
    each chunk and, last, in all. No token goes over a border, so texts can be cut there."""
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))

    def make():
        t = transducer(model)

        def compute(batch: pa.RecordBatch) -> tuple:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            return [t.chunks(x) for x in texts], [t.offsets(x).tolist() for x in texts]

        return compute

    return computed(rows, ["doc_id"], "chunks array<string>, offsets array<bigint>", make)
