"""Operators over documents against plain versions, with nulls, ties, repeats and long texts."""

import hashlib
import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from barlake.llm import components, encoding, lines, near, packing, quality, secrets, simhash, syncmers  # noqa: E402
from barlake.llm.bpe import Codec  # noqa: E402
from barlake.llm.words import LibraryCodec  # noqa: E402
from barlake.session import shared_folder  # noqa: E402

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def given(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def same(got, expected):
    assert Counter(got) == Counter(expected)


def test_quality_counts(docs, no_docs):
    got = quality.judged(docs).collect()
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
          for r in got], [(i, *brute.quality_counts(t)) for i, t in given(docs)])
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.judged(no_docs).collect() == []


def test_quality_model_is_expectation_maximisation(spark):
    rng = np.random.default_rng(0)
    n = len(quality.RULES)
    good = rng.random(4000) < 0.7
    votes = np.where(rng.random((4000, n)) < np.where(good, 0.95, 0.4)[:, None], 1, 0)
    votes[rng.random((4000, n)) < 0.2] = -1
    table = Counter(map(tuple, votes.tolist()))
    rows = spark.createDataFrame([(list(v), c) for v, c in table.items()],
                                 "votes array<int>, n bigint")
    got = {tuple(r.votes): r.quality for r in quality.fitted(rows).collect()}
    patterns = sorted(table)
    v, c = np.array(patterns), np.array([table[p] for p in patterns], dtype=float)
    share, a, b = quality.SHARE, np.full(n, quality.RIGHT_GOOD), np.full(n, quality.RIGHT_BAD)

    def posterior():
        odds = np.log(share / (1 - share)) + np.where(
            v == 1, np.log(a) - np.log(1 - b), np.where(v == 0, np.log(1 - a) - np.log(b), 0)
        ).sum(axis=1)
        return 1 / (1 + np.exp(-odds))

    for _ in range(quality.ROUNDS):
        q = posterior()
        voted, w = v >= 0, quality.WEIGHT
        share = (w * quality.SHARE + c @ q) / (w + c.sum())
        a = (w * quality.RIGHT_GOOD + (c * q) @ (v == 1)) / (w + (c * q) @ voted)
        b = (w * quality.RIGHT_BAD + (c * (1 - q)) @ (v == 0)) / (w + (c * (1 - q)) @ voted)
    assert np.allclose([got[p] for p in patterns], posterior(), atol=1e-9)
    verdict = np.array([got[tuple(x)] >= 0.5 for x in votes.tolist()])
    assert (verdict == good).mean() > 0.9


def test_codecs_equal_the_library(docs):
    random.seed(3)
    letters = ("ab Zéß'sstre0 1²½\t\n\r\x0b\x1c\x1f\x85\xa0 ​́漢字١！?!#_-…“”’ſKİ\U0001f600　\x00­ǅ")
    texts = [t or "" for _, t in given(docs)] + [
        "".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(1500)]
    texts += ["ab" * 5000, " a", "a ", "  ", "\n \n", "a\0b c", "a  b   c \n d\n e"]
    for path, make in ((WORD_BPE, Codec), (BYTE_BPE, Codec), (BYTE_BPE, LibraryCodec)):
        library, codec = Tokenizer.from_file(path), make(path)
        ids = (list(codec.encode_all(texts)) if make is LibraryCodec
               else [codec.encode(t) for t in texts])
        for t, packed in zip(texts, ids, strict=True):
            own = np.frombuffer(packed, "<u4").tolist()
            assert own == library.encode(t, add_special_tokens=False).ids, repr(t[:60])
            if make is Codec:
                assert codec.decode(packed) == library.decode(
                    own, skip_special_tokens=False).encode(), repr(t[:60])


def test_round_trip_query(docs, no_docs):
    library = Tokenizer.from_file(WORD_BPE)
    expected = []
    for i, t in given(docs):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                         hashlib.sha256(text.encode()).hexdigest()))
    same([tuple(r) for r in encoding.round_trip(docs, WORD_BPE).collect()], expected)
    tokens = encoding.encode(docs, BYTE_BPE)
    same([(r.doc_id, r.text) for r in encoding.decode(tokens, BYTE_BPE).collect()],
         [(i, t or "") for i, t in given(docs)])
    assert encoding.round_trip(no_docs, WORD_BPE).collect() == []


def test_packing_covers_every_token_once(docs, no_docs):
    library = Tokenizer.from_file(BYTE_BPE)
    rows = packing.pack(docs, BYTE_BPE, size=64).collect()
    ids = defaultdict(list)
    for i, t in given(docs):
        ids[i].append(np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4"))
    wanted = Counter((i, len(x)) for i, many in ids.items() for x in many)
    assert Counter((r.doc_id, r.doc_tokens) for r in rows if r.start == 0) == wanted
    for r in rows:
        assert any(zlib.crc32(x[r.start:r.start + r.length].tobytes()) == r.ids_crc32
                   for x in ids[r.doc_id] if len(x) == r.doc_tokens)
    assert sum(r.length for r in rows) == sum(len(x) for many in ids.values() for x in many)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for k, pieces in sequences.items():
        pieces.sort()
        ends = np.cumsum([n for _, n in pieces])
        assert [o for o, _ in pieces] == [0, *ends[:-1].tolist()]
        assert ends[-1] == 64 or k == max(sequences)
    assert packing.pack(no_docs, BYTE_BPE).collect() == []


def test_simhash_components(docs, no_docs):
    rows = given(docs)
    fp = [(i, brute.simhash(t)) for i, t in rows]
    roots = brute.components(fp)
    same([tuple(r) for r in simhash.components(docs).collect()],
         [(i, f"{f:016x}", c) for (i, f), c in zip(fp, roots, strict=True)])
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    same([r.doc_id for r in kept.collect()],
         [i for (i, _), c in zip(fp, roots, strict=True) if i is None or i == c])
    assert simhash.components(no_docs).collect() == []


def test_links_find_every_pair_within_the_radius(spark):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    fps = set(seeds)
    for s in seeds:  # chains and clusters
        for _ in range(12):
            s ^= 1 << rng.randrange(64)
            fps |= {s, s ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))}
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    edges = simhash.links(spark.createDataFrame(signed, "fp bigint"))
    assert edges.where("bit_count(a ^ b) > 2").count() == 0
    root = {r.node: r.root for r in components.roots(edges).collect()}
    expected = brute.components([(k, f) for k, f in enumerate(fps)])
    group = defaultdict(set)
    for (s,), c in zip(signed, expected, strict=True):
        group[c].add(root.get(s, s))
    assert all(len(g) == 1 for g in group.values())
    assert len(set.union(*group.values())) == len(group)


def test_near_copies_by_exact_similarity(spark, no_docs):
    rng = random.Random(9)
    rows = []
    for g in range(40):  # edited copies, on either side of 0.8, in chains
        w = [f"w{rng.randrange(10 ** 6)}" for _ in range(rng.choice((30, 120, 400)))]
        for _ in range(4):
            rows.append((len(rows), " ".join(w)))
            w = list(w)
            for _ in range(rng.choice((1, 1, 2, len(w) // 60, len(w) // 45, len(w) // 30))):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10 ** 6)}"
    rows += [(1000, ""), (1001, None), (1002, "a b"), (1003, "A  b"), (None, rows[0][1])]
    runs = [brute.WORD.findall((t or "").lower()) for _, t in rows]
    sets = [{tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in runs]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    far = 0
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or 5 * both >= 4 * len(sets[a] | sets[b]):
                far += (brute.simhash(rows[a][1]) ^ brute.simhash(rows[b][1])).bit_count() > 2
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    assert far > 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    same([r.doc_id for r in near.one_of_each(docs).collect()],
         [i for k, (i, _) in enumerate(rows) if find(k) == k or i is None])
    assert near.components(no_docs).collect() == []


def test_similar_texts_that_share_no_fingerprint_are_one_group(spark):
    rng = random.Random(4)
    short = [f"w{rng.randrange(10 ** 6)}" for _ in range(84)]
    own, long = set(near.fingerprints(near.shingles(" ".join(short)))), list(short)
    for _ in range(20):  # words are added so that as few parts as possible stay alike
        tries = [[*long, f"x{rng.randrange(10 ** 6)}"] for _ in range(300)]
        long = min(tries, key=lambda w: len(own & set(near.fingerprints(near.shingles(" ".join(w))))))
    assert not own & set(near.fingerprints(near.shingles(" ".join(long))))
    other = [f"y{rng.randrange(10 ** 6)}" for _ in range(60)]
    rows = [(3, " ".join(long)), (2, " ".join(short)), (7, " ".join(short[:-1])), (8, " ".join(other)),
            (9, " ".join(short[:75])), (10, " ".join(other[:30])), (11, " ".join(short[:60]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    same([tuple(r) for r in near.components(docs).collect()],
         [(3, 2), (2, 2), (7, 2), (8, 8), (9, 2), (10, 10), (11, 11)])
    same([r.doc_id for r in near.one_of_each(docs).collect()], [2, 8, 10, 11])


def test_texts_of_one_id_are_grouped_apart(spark):
    rows = [(1, "a b c d e f g"), (5, "a b c d e f g"), (5, "one text of its own"), (6, "h i j k l m n"),
            (6, "H i j  k l m n"), (None, "h i j k l m n"), (None, "p q"), (None, "p q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    same([(r.doc_id, r.text.split()[0].lower()) for r in near.one_of_each(docs).collect()],
         [(1, "a"), (5, "one"), (6, "h"), (None, "h"), (None, "p"), (None, "p")])


def test_first_shingles_and_parity_lose_no_similar_set():
    rng = np.random.default_rng(8)
    for union in (5, 9, 10, 20, 64, 75, 150, 700):
        shared = -(-4 * union // 5)
        for _ in range(50):
            h = np.unique(rng.integers(0, 1 << 64, union, dtype=np.uint64))
            common = np.sort(rng.choice(h, union // 2, replace=False))
            rank = rng.integers(1, 50, len(common))
            rng.shuffle(h)
            side = rng.random(union - shared) < rng.choice((0.0, 0.5))
            a, b = (np.sort(np.concatenate([h[:shared], h[shared:][k]])) for k in (side, ~side))
            assert set(near.early(a, common, rank).tolist()) & set(near.early(b, common, rank).tolist())
            x, y = near.parity(a), near.parity(b)
            while len(x) != len(y):
                x, y = (v[:len(v) // 2] ^ v[len(v) // 2:] if len(v) > min(len(x), len(y)) else v for v in (x, y))
            assert int(np.bitwise_count((x ^ y).view(np.uint64)).sum()) <= union - shared


def test_similar_sets_share_a_simhash_of_the_whole_or_of_a_part():
    rng = np.random.default_rng(7)
    for union in (5, 10, 14, 20, 25, 30, 59, 75, 119, 150, 240, 480, 960):
        common = -(-4 * union // 5)
        for _ in range(40):
            h = np.unique(rng.integers(0, 1 << 64, union, dtype=np.uint64))
            rng.shuffle(h)
            own = rng.random(union - common) < 0.5
            a, b = (near.fingerprints(np.sort(np.concatenate([h[:common], h[common:][side]])))
                    for side in (own, ~own))
            assert set(a) & set(b)
    h = np.unique(rng.integers(0, 1 << 64, 5000, dtype=np.uint64))
    for k in range(20):  # the ball around the whole: its six values come first
        a, b = near._simhash(h, np.array([0])), near._simhash(np.delete(h, k), np.array([0]))
        far = (int(a[0]) ^ int(b[0])).bit_count()
        met = set(near.fingerprints(h)[:6]) & set(near.fingerprints(np.delete(h, k))[:6])
        assert met or far > near.RADIUS


def test_simhash_of_a_set_counts_bits_of_its_hashes():
    h = np.unique(np.random.default_rng(3).integers(0, 1 << 64, 500, dtype=np.uint64))
    starts = np.array([0, 1, 3, 200])
    for chunk in (near.CHUNK, 7):
        before, near.CHUNK = near.CHUNK, chunk
        try:
            got = near._simhash(h, starts)
        finally:
            near.CHUNK = before
        for value, a, b in zip(got, starts, [*starts[1:], 500], strict=True):
            own = [int(x) for x in h[a:b]]
            assert int(value) == sum(1 << k for k in range(64)
                                     if 2 * sum(x >> k & 1 for x in own) > len(own))


def test_components_of_a_long_path(spark):
    n = 3000
    order = list(range(n))
    random.Random(1).shuffle(order)
    rows = [(order[k], order[k + 1]) for k in range(n - 1)] + [(n, n), (n + 1, n + 2)]
    got = {r.node: r.root for r in components.roots(
        spark.createDataFrame(rows, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(n)} | {n + 1: n + 1, n + 2: n + 1}


def test_edited_text_and_likeness(docs, no_docs):
    rows = [(i, t or "") for i, t in given(docs)]
    got = syncmers.compared(docs).collect()
    assert len(got) == len(rows)
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    texts = sorted(((r.doc_id, r.text or "") for r in unique.collect()), reverse=True)
    got = {r.doc_id: r for r in syncmers.compared(unique).collect()}
    for k, (i, t) in enumerate(texts):
        following = texts[(k + 1) % len(texts)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + following[:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].n_chars == len(t)
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[13].fingerprint == got[14].fingerprint and got[14].near_next == 1
    assert got[4].fingerprint == "" and got[4].near_next == 1  # empty, then a null text
    assert 0.3 < got[20].near_edited < 1 and got[21].near_next > 0.9
    assert got[9].near_next > 0.6
    assert syncmers.compared(no_docs).collect() == []


def test_likeness_sees_every_anchor(spark):
    words = [f"w{k}" for k in range(5000)]
    changed = words[:1000] + [f"x{k}" for k in range(20)] + words[1020:]
    other = [f"y{k}" for k in range(5000)] + words[2000:2100]
    docs = spark.createDataFrame([(3, " ".join(words)), (2, " ".join(changed)), (1, " ".join(other))],
                                 "doc_id long, text string")
    found = defaultdict(set)
    for r in syncmers.anchors(docs).collect():
        found[r.doc_id].add(r.anchor)
    got = {r.doc_id: r for r in syncmers.compared(docs).collect()}
    for i, j in ((3, 2), (2, 1), (1, 3)):
        assert got[i].near_next == pytest.approx(
            2 * len(found[i] & found[j]) / (len(found[i]) + len(found[j])))
    assert 0.98 < got[3].near_next < 1 and 0 < got[1].near_next < 0.03
    assert len({r.anchors_sha256 for r in got.values()}) == 3


def test_order_over_slices(spark):
    ids = [3, 4, 9, 10, 11, 500, 501, 2_000, 2_001, 90_000, 90_001, 90_002]
    docs = spark.createDataFrame([(i, f"text of {i} " * 4) for i in ids],
                                 "doc_id long, text string")
    got = {r.doc_id: r.edited for r in syncmers.edited(docs, per_slice=2).collect()}
    down = sorted(ids, reverse=True)
    for k, i in enumerate(down):
        t, following = (f"text of {x} " * 4 for x in (i, down[(k + 1) % len(down)]))
        half = len(t) // 2
        assert got[i] == t[:len(t) - half] + following[:half]


def test_closed_syncmers_are_context_free(spark):
    words = [f"w{k}" for k in range(300)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "other start " + " ".join(words[90:]))],
                                 "doc_id long, text string")
    found = defaultdict(dict)
    for r in syncmers.anchors(docs).collect():
        found[r.doc_id][r.position] = r.anchor
    inside = {p - 90 + 2: a for p, a in found[1].items() if p >= 90}
    assert inside.items() <= found[2].items() and len(inside) > 80


def test_secret_spans(docs, no_docs):
    got = secrets.scan(docs).collect()
    base = [r.kind for r in secrets.BASE]
    same([(r.doc_id, tuple((s.kind, s.start, s.end) for s in r.spans if s.kind in base))
          for r in got], [(i, tuple(brute.base_spans(t))) for i, t in given(docs)])
    assert secrets.scan(no_docs).collect() == []


def test_ledger_scans_only_what_is_new(spark, docs):
    folder = shared_folder(spark, "ledger-test")
    some = docs.where("doc_id < 10")
    secrets.scan(some, folder).collect()
    first = secrets.ledger(spark, folder).count()
    assert first == some.selectExpr("coalesce(text, '')").distinct().count()
    secrets.scan(some, folder).collect()
    assert secrets.ledger(spark, folder).count() == first
    whole = secrets.scan(docs, folder).count()
    blobs = docs.selectExpr("coalesce(text, '')").distinct().count()
    assert whole == docs.count() and secrets.ledger(spark, folder).count() == blobs
    secrets.scan(some, folder, secrets.Rules("other", secrets.BASE)).collect()
    assert secrets.ledger(spark, folder).count() == blobs + first


def test_redaction(docs):
    clean = {(r.doc_id, r.text) for r in secrets.redact(docs).collect()}
    expected = set()
    for i, t in given(docs):
        spans = [(s, e) for _, s, e in secrets.RULES.scan(t or "")]
        out, at = [], 0
        for s, e in spans:
            if s > at or not out:
                out.append((t[at:s], True))
            at = max(at, e)
        expected.add((i, t if not spans else "[secret]".join([x for x, _ in out] + [t[at:]])))
    assert clean == expected
    assert secrets.redact(docs).columns == docs.columns


def test_line_windows(docs, no_docs):
    got = lines.deduplicate(docs)
    assert got.columns == [c for c in docs.columns if c != "n_removed"] + ["n_worded", "n_removed"]
    rows = given(docs)
    same([(r.doc_id, r.text, r.n_removed) for r in got.collect()],
         [(i, t, n) for (i, _), (t, n) in zip(rows, brute.deduplicated(rows), strict=True)])
    assert lines.deduplicate(no_docs).collect() == []


def test_line_windows_belong_to_rows(spark):
    shared = "\n".join(f"shared line {k}" for k in range(4))
    own = "\n".join(f"line {k} of one text only" for k in range(9))
    twice = "\n".join(f"line {k} of equal rows" for k in range(3))
    rows = [(1, shared), (None, own), (None, "a head\n" + shared), (7, own + " x"),
            (7, "b head\n" + shared), (9, twice), (9, twice)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lines.deduplicate(docs)
    same([(r.doc_id, r.text, r.n_removed) for r in got.collect()],
         [(1, "", 4), (None, own, 0), (None, "a head\n" + shared, 0),
          (7, "line 8 of one text only x", 8), (7, "b head", 4), (9, twice, 0), (9, "", 3)])
    assert got.where("n_removed > n_worded").count() == 0


@pytest.mark.parametrize("name", ["op1_quality_rules", "op6_fingerprints", "op10_line_dedup"])
def test_native_queries_have_no_python(spark, sf, name):
    from barlake.llm import queries

    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
