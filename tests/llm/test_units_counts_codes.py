"""Fill-in-the-middle, token counts and vector codes against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given as cases
from hypothesis import settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from barlake.llm import codes, middle, transducer
from barlake.llm.arrow import computed

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BIG = 2 ** 53 + 1


def given(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def test_ids_beside_a_null_stay_whole(spark):
    rows = spark.createDataFrame([(BIG, "a"), (None, "b"), (5, None)], "id long, text string").coalesce(1)
    got = computed(rows, ["id"], "n int", lambda: lambda b: ([1] * b.num_rows,)).collect()
    assert {r.id for r in got} == {BIG, None, 5}
    docs = rows.withColumnRenamed("id", "doc_id")
    for out in (middle.transformed(docs), transducer.counted(docs, MODEL)):
        assert {r.doc_id for r in out.collect()} == {BIG, None, 5}


# -- fill in the middle -------------------------------------------------------------------

def plain_middle(doc_id, text):
    t = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(units), "plain", None, None, t
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, docs, no_docs):
    more = spark.createDataFrame(
        [(k, t) for k, t in enumerate(["a<P>b", "<M>", "x<", "<<S", ">", "S>", "P>S>M>", "\0", "\n\n",
                                       "ab" * 9000, "é" * 9000, "a1" * 300, "漢字 kana 漢字"] * 6)],
        "doc_id long, text string")
    for table in (docs, more):
        got = middle.transformed(table).withColumn("back", middle.restored()).collect()
        assert Counter(tuple(r)[:6] for r in got) == Counter(plain_middle(*r) for r in given(table))
        assert {(r.doc_id, r.back) for r in got} == {(i, t or "") for i, t in given(table)}
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert middle.transformed(no_docs).collect() == []


@settings(max_examples=150, deadline=None)
@cases(st.text(st.sampled_from("ab z.\n1é漢\U0001f600<"), max_size=300), st.sampled_from([3, 50, 4096]))
def test_chunk_summaries_locate_every_unit(text, longest):
    held, middle.LONGEST = middle.LONGEST, longest
    try:
        cutter = middle.Cutter()
        for t in (text, text * 5, text):
            m = cutter.measured(t)
            ends = [0, *[u.end() for u in middle.UNIT.finditer(t)]]
            assert m.n == len(ends) - 1
            assert [m.place(k) for k in range(len(ends))] == ends
    finally:
        middle.LONGEST = held


def test_shared_passages_share_chunks():
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefgh .") for _ in range(20_000))
    first, second = f"one {passage} end", f"another start, {passage}"
    cutter = middle.Cutter()
    cutter.measured(first)
    before = len(cutter.known)
    cutter.measured(second)
    assert before > 80 and len(cutter.known) - before <= 4


def test_summaries_are_bounded(monkeypatch):
    monkeypatch.setattr(middle, "CACHED", 500)
    cutter = middle.Cutter()
    for k in range(50):
        t = f"{k} " + " ".join(f"w{k * j}" for j in range(100))
        assert cutter.measured(t).n == len(middle.UNIT.findall(t))
    assert cutter.held < 5_000


# -- token counts -------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def machine():
    return transducer.Transducer(MODEL)


def test_counts_equal_the_library(docs, no_docs, library):
    got = Counter(tuple(r) for r in transducer.counted(docs, MODEL).collect())
    want = Counter()
    for i, t in given(docs):
        n = len(library.encode(t or ""))
        want[i, len((t or "").encode()), n, n > 4096] += 1
    assert got == want
    assert transducer.counted(no_docs, MODEL).collect() == []


@settings(max_examples=400, deadline=None)
@cases(st.one_of(
    st.text(max_size=60), st.text(st.sampled_from("abeinrst ▁"), max_size=80),
    st.lists(st.sampled_from(["  ", " ", "the", "ing", "▁", "\n", "<s>", "</s>", "<unk>", "<0x41>", "==",
                              "aaaa", "é", "漢", "\0", "\t"]), max_size=40).map("".join)))
def test_any_text_counts_as_in_the_library(machine, library, text):
    text = text.encode("utf-8", "ignore").decode()
    assert machine.count(text) == len(library.encode(text))


def test_vocabulary_strings_and_long_stretches(machine, library):
    rng = random.Random(5)
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32_000)]
    for n in (3, 30, 300, 3000):
        text = "".join(rng.choice(pieces) for _ in range(n))
        for t in (text, text.replace(" ", ""), " " * n + text + " " * n, "a" * n, " " * n):
            assert machine.count(t) == len(library.encode(t))


def test_maps_compose(machine):
    word = "internationalisation" * 7
    for k in range(0, len(word), 9):
        state, count = machine.map(0, word[:k])
        to, more = machine.map(state, word[k:])
        assert (to, count + more) == machine.map(0, word)
    assert any(emitted < 1 for row in machine.next for _, emitted in row.values())


def test_states_start_anew(monkeypatch, library):
    monkeypatch.setattr(transducer, "CACHED_STATES", 300)
    monkeypatch.setattr(transducer, "CACHED_CHUNKS", 40)
    small, rng = transducer.Transducer(MODEL), random.Random(1)
    for _ in range(60):
        t = " ".join("".join(rng.choice("aeinrst") for _ in range(7)) for _ in range(20))
        assert small.count(t) == len(library.encode(t))
    assert len(small.states) < 3000


def test_chunk_offsets_are_cuts(docs, library):
    for r in transducer.chunk_offsets(docs, MODEL).limit(8).collect():
        assert len(r.offsets) == len(r.chunks) + 1
        for k in range(0, len(r.chunks), max(1, len(r.chunks) // 5)):
            text = "".join(r.chunks[:k]).replace("▁", " ")[1:]
            if text:
                assert r.offsets[k] == len(library.encode(text))


# -- vector codes -------------------------------------------------------------------------

def plain_codes(rows, parts=4, entries=256, rounds=4):
    """The contract, word by word."""
    kept = [(i, [int(np.floor(1024 * np.float64(x))) for x in v], la) for i, v, la in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    cut = [[v[p * w:(p + 1) * w] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def far(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return [[min(range(len(books[p])), key=lambda e: (far(c[p], books[p][e]), e))
                 for p in range(parts)] for c in cut]

    for _ in range(rounds):
        own = assign()
        for p in range(parts):
            groups = defaultdict(list)
            for c, o in zip(cut, own, strict=True):
                groups[o[p]].append(c[p])
            for e, members in groups.items():
                books[p][e] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    own = assign()
    errors = [sum(far(c[p], books[p][o[p]]) for p in range(parts))
              for c, o in zip(cut, own, strict=True)]
    by_label = Counter()
    for (_, _, la), e in zip(kept, errors, strict=True):
        by_label[la] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, "".join(f"{e:02x}" for e in o), err, by_label[la], digest)
                   for (i, _, la), o, err in zip(kept, own, errors, strict=True))


VECTORS = "vec_id long, embedding array<float>, label int, v string, at string, codes string, error string"


def vectors(n=150, dims=8, seed=4):
    rng = np.random.default_rng(seed)
    out = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.2, dims)],
            None if i % 5 == 0 else int(i % 3)) for i in rng.permutation(n)]
    out += [(BIG, out[0][1], 1), (None, out[1][1], 2), (3, out[2][1], 2), (3, out[3][1], 2), out[4],
            (n, None, 1), (n + 1, [None] * dims, 1), (n + 2, [float("nan")] * dims, 1),
            (n + 3, [float("inf")] + [0.0] * (dims - 1), 1), (n + 4, [0.0] * dims, 7)]
    return out + [(n + 10 + k, [0.125] * dims, 1) for k in range(40)]


@pytest.mark.parametrize("entries", [4, 16, 256])
def test_vector_codes(spark, entries):
    rows = vectors()
    table = spark.createDataFrame([(*r, "x", "y", "z", "e") for r in rows], VECTORS).repartition(3)
    got = Counter(tuple(r) for r in codes.compressed(table, entries=entries).collect())
    assert got == plain_codes(rows, entries=entries)


def test_vector_codes_of_nothing_and_of_bad_shapes(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert codes.compressed(empty).collect() == []
    assert codes.compressed(empty).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    ragged = spark.createDataFrame([(1, [1.0] * 8, 1), (2, [1.0] * 4, 1)],
                                   "vec_id long, embedding array<float>, label int")
    with pytest.raises(Exception, match="other lengths"):
        codes.compressed(ragged).collect()
    with pytest.raises(ValueError, match="equal parts"):
        codes.compressed(ragged.where("vec_id = 2"), parts=3).collect()
    with pytest.raises(Exception, match="4194304"):
        codes.compressed(ragged.where("vec_id = 2").withColumn(
            "embedding", F.transform("embedding", lambda x: x * 1e6))).collect()


@settings(max_examples=60, deadline=None)
@cases(st.integers(0, 10 ** 6), st.sampled_from([1, 2, 5, 16]), st.sampled_from([1, 3, 40]),
       st.sampled_from([1, 7, 16, 300]), st.sampled_from([3, 100, 3000]))
def test_cells_find_the_nearest_entry(seed, dims, entries, width, spread):
    rng = np.random.default_rng(seed)
    book = rng.integers(-spread, spread, (entries, dims))
    x = rng.integers(-2 * spread, 2 * spread, (60, dims))
    search = codes.Cells(book, width)
    for _ in range(2):  # from new cells, then from known ones
        entry, least = search.nearest(x)
        far = ((x[:, None] - book[None]) ** 2).sum(axis=-1)
        assert (entry == far.argmin(axis=1)).all() and (least == far.min(axis=1)).all()


def test_cells_rule_entries_out():
    rng = np.random.default_rng(1)
    book = rng.normal(0, 128, (256, 16)).astype(np.int64)
    search = codes.Cells(book)
    search.nearest(rng.normal(0, 128, (500, 16)).astype(np.int64))
    assert np.mean([len(few) for few in search.known.values()]) < 20


def test_smallest_rows_by_steps(spark, monkeypatch):
    monkeypatch.setattr(codes, "FAN_IN", 2)
    rows = spark.range(500).select((F.lit(499) - F.col("id")).alias("vec_id"), F.array(
        F.col("id")).alias("v")).repartition(9)
    assert codes.smallest(rows, 20) == [[499 - k] for k in range(20)]
