import random

import numpy as np
from pyspark.sql import functions as F

from plenara.llm import neardup
from plenara.llm.components import components


def similarity(a, b):
    """Matched words of the longer text, by the full table, without a band."""
    a, b = list(a), list(b)
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1] / max(len(a), len(b)) if a or b else 0.0


def labelled(items):
    seen = {}
    out = set()
    for x in items:
        seen[x] = seen.get(x, 0) + 1
        out.add((x, seen[x]))
    return out


def classes(texts, share=0.4):
    words = [neardup.words_of(t or "") for t in texts]
    parts = [labelled([tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []) for w in words]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = words[i], words[j]
            near = min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(parts[i] & parts[j]) >= share * max(len(parts[i]), len(parts[j]))
            if a and b and (a == b or near and similarity(a, b) >= 0.8 - 1e-9):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


def corpus(seed=5):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 5)))
    passage = [word() for _ in range(60)]
    texts = [None, "", "--- !", "--- !", "one", "One.", "two words", "a b c d e f", "a b c d e f g", "x " * 400, "x " * 500]
    for n in (30, 60, 120, 300):
        base = [word() for _ in range(n)]
        texts.append(" ".join(base))
        for _ in range(25):
            copy = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 3, 3, 30])):
                at = rnd.randrange(len(copy))
                copy[at : at + rnd.choice([0, 1])] = [word()]
            texts.append((" " if rnd.random() < 0.7 else ", ").join(copy))
    for _ in range(30):
        texts.append(" ".join([word() for _ in range(rnd.randrange(20, 90))] + passage))
    rnd.shuffle(texts)
    return texts


def test_classes_lie_between_close_and_linked_pairs(spark):
    """All close pairs are in one class, and no class joins what brute force doesn't link; here nearly all links are found."""
    texts = corpus()
    may, must = classes(texts), classes(texts, neardup.CLOSE)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, class_id string")
    rows = {r.doc_id: r for r in neardup.near_classes(docs).collect()}
    got = [rows[i].class_id for i in range(len(texts))]
    assert all(got[i] == got[must[i]] and may[got[i]] == may[i] and got[i] <= i for i in range(len(texts)))
    assert len(set(got)) <= 1.03 * len(set(may)) < len(set(must))
    assert all(rows[i].class_size == got.count(got[i]) for i in rows)
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(got))


def test_alignment_equals_the_full_table():
    rnd = random.Random(1)
    for _ in range(400):
        a = [rnd.randrange(30) for _ in range(rnd.randrange(1, 60))]
        b = list(a)
        for _ in range(rnd.randrange(9)):
            at = rnd.randrange(len(b) + 1)
            b[at : at + rnd.choice([0, 1, 2])] = [rnd.randrange(30)] * rnd.choice([0, 1, 2])
        x, y = np.array(a, np.uint32), np.array(b, np.uint32)
        assert neardup.aligned(x, y) == (len(b) > 0 and similarity(a, b) >= 0.8 - 1e-9)
        h = neardup.labelled(x.astype(np.uint64))
        assert len(set(h.tolist())) == len(x)


def test_very_long_texts_are_aligned_whole():
    rnd = np.random.default_rng(4)
    a = rnd.integers(0, 5000, 60_000).astype(np.uint32)
    b = np.delete(a, rnd.choice(60_000, 6_000, replace=False))
    b[::11] = 7000
    assert neardup.aligned(a, b) and not neardup.aligned(a, b, 0.85)
    assert neardup.sketches(neardup.shingles(a.astype(np.uint64))).shape == (neardup.SKETCHES,)
    assert not neardup.linked(a, b) and neardup.linked(a, np.delete(a, range(3000, 9000)))


def test_edited_copies_are_found_again(spark):
    """Of pairs in which a tenth of the words differ nine in ten are linked at least; in truth nearly all are."""
    rnd = random.Random(9)
    texts = []
    for n in (40, 60, 90, 140, 200, 300, 600) * 12:
        words = [f"w{min(rnd.randrange(1, 4000), rnd.randrange(1, 4000))}" for _ in range(n)]
        other = list(words)
        for at in rnd.sample(range(n), n // 10):
            other[at] = f"v{rnd.randrange(10**6)}"
        texts += [" ".join(words), " ".join(other)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.near_classes(docs).collect()}
    found = sum(got[i] == got[i + 1] == i for i in range(0, len(texts), 2))
    assert found >= 0.95 * len(texts) / 2


def test_repeated_rows_null_ids_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(7, text), (7, text), (None, text + " end"), (3, "other text of its own"), (None, None), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or -1, r.class_id or -1, r.class_size) for r in neardup.near_classes(docs).collect()))
    assert got == [(-1, -1, 1), (-1, -1, 1), (-1, 7, 3), (3, 3, 1), (7, 7, 3), (7, 7, 3)]
    assert sorted((r.doc_id or -1) for r in neardup.deduplicated(docs).collect()) == [-1, -1, 3, 7]
    assert neardup.near_classes(docs.where(F.lit(False))).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    rnd = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 180)] + [(300, 300), (400, 401), (401, 400)]
    edges = [edges[i] for i in rnd.permutation(len(edges))]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 180)} | {400: 400, 401: 400}


def test_short_texts_that_are_similar_always_meet(spark):
    rnd = random.Random(5)
    texts = []
    for n in [5] * 20 + [8] * 20 + [9] * 20 + [*range(6, 36)]:
        words = [f"w{rnd.randrange(10**9)}" for _ in range(n)]
        texts += [" ".join(words), " ".join([*words, "more"] if n % 2 else ["more", *words])]
    met = [set(neardup.buckets(neardup.shingles(neardup.hashed(neardup.words_of(t)))).tolist()) for t in texts]
    assert all(met[i] & met[i + 1] for i in range(0, len(texts), 2))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.near_classes(docs).collect()}
    assert got == {i: i - i % 2 for i in range(len(texts))}


def test_linked_texts_that_meet_in_no_sketch_are_in_one_class(spark):
    """Pairs that share half of their shingles, and crowds around a text that share a passage or belong to one class; links as brute force finds them."""
    rnd = random.Random(21)
    word = lambda: f"w{rnd.randrange(10**7)}"
    texts, passage = [], [word() for _ in range(80)]

    def edited(words, every):
        return [word() if at % every == every // 2 else x for at, x in enumerate(words)]

    for n in (40, 60, 90, 140, 300) * 16:
        words = [word() for _ in range(n)]
        texts += [words, edited(words, 9)]
    for k in range(150):
        texts.append(passage + [word() for _ in range(15 + k % 10)])
    one = [word() for _ in range(100)]
    texts += [edited(one, 9), *(one[:k] + [word()] + one[k + 1 :] for k in range(0, 100, 2))]
    texts = [" ".join(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.class_id for r in neardup.near_classes(docs).collect()}
    assert [got[i] for i in range(len(texts))] == classes(texts)


def test_lists_of_any_size_are_compared_whole(spark):
    """Every two texts of a list whose classes differ and that haven't met before are in one unit, in different blocks or in one."""
    rnd = np.random.default_rng(2)
    for size, roots in ((3, 2), (70, 70), (300, 2), (400, 40)):
        root = np.where(np.arange(size) < size // 2, 0, rnd.integers(0, roots, size))
        members = [(k, int(rnd.integers(50, 80)), int(root[k]), -1 - k if k % 3 else -1) for k in range(size)]
        lists = spark.createDataFrame([(7, members)], "list long, members array<struct<num long, n int, root long, before long>>")
        met = set()
        for _, of in neardup._units(lists).toPandas().groupby(["i", "j"]):
            rows = list(of.itertuples())
            met |= {(min(x.num, y.num), max(x.num, y.num)) for x in rows for y in rows if x.num != y.num and (x.i == x.j or x.block != y.block)}
        may = {(x, y) for x in range(size) for y in range(x + 1, size) if root[x] != root[y] and members[x][3] != members[y][3] and min(members[x][1], members[y][1]) >= 0.8 * max(members[x][1], members[y][1])}
        assert may <= met


def test_texts_that_meet_in_many_lists_are_paired_once(spark):
    """Lists 1, 2, 3 with other texts between: the pair of 0 and 1 comes from the first only; 2 and 3 meet the rest where they come in."""
    words = [f"w{i}" for i in range(60)]
    schema = "list long, members array<struct<num long, n int, root long, before long, earlier array<long>>>"
    one = [(k, 60, k, -1 - k, []) for k in (0, 1)]
    two = [(0, 60, 0, 1, [1]), (2, 60, 2, -3, [])]
    three = [(0, 60, 0, 2, [2, 1]), (1, 60, 1, 1, [1]), (2, 60, 2, 2, [2]), (3, 60, 3, -4, [])]
    units = neardup._units(spark.createDataFrame([(1, one), (2, two), (3, three)], schema))
    marks = neardup._marks(neardup.hashed(neardup.words_of(" ".join(words))).astype(np.uint32)).tobytes()
    texts = spark.createDataFrame([(k, 60, bytearray(marks)) for k in range(4)], "num long, n int, marks binary")
    pairs = units.join(texts, "num").groupBy("list", "i", "j").applyInArrow(neardup._unit_pairs, "a long, b long")
    assert sorted((r.a, r.b) for r in pairs.collect()) == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]


def test_crowds_that_are_not_alike_enough_are_not_read_whole(spark, monkeypatch):
    """Texts of a crowd of which a quarter of the words differ share shingles in many lists, but no pair of them goes on to be aligned."""
    rnd = random.Random(3)
    base, texts = [f"w{rnd.randrange(10**7)}" for _ in range(240)], []
    for _ in range(40):
        words = list(base)
        for at in rnd.sample(range(240), 36):
            words[at] = f"v{rnd.randrange(10**7)}"
        texts.append(neardup.hashed(neardup.words_of(" ".join(words))).astype(np.uint32))
    assert all(len(np.intersect1d(a, b)) < 0.8 * 240 for k, a in enumerate(texts) for b in texts[:k])
    words = spark.createDataFrame([(k, bytearray(t.tobytes())) for k, t in enumerate(texts)], "num long, words binary")
    placed = spark.createDataFrame([(k, 240, k) for k in range(40)], "num long, n int, root long")
    read = []
    monkeypatch.setattr(neardup, "_verified", lambda pairs, words: read.append(pairs.count()) or pairs)
    neardup._rest(words, placed)
    assert read == [0]


def test_texts_that_share_only_a_few_shingles_are_not_compared(spark, monkeypatch):
    """A phrase that many else different texts have puts them in one list; what a linked text must share tells that none of them is linked."""
    rnd = random.Random(8)
    phrase = [f"w{k}" for k in range(9)]
    texts = [phrase + [f"v{rnd.randrange(10**8)}" for _ in range(240)] for _ in range(60)]
    other = [*texts[0][:100], "more", *texts[0][101:200], "words", *texts[0][201:]]
    rows = [(k, bytearray(neardup.hashed(neardup.words_of(" ".join(t))).astype(np.uint32).tobytes())) for k, t in enumerate([*texts, other])]
    words = spark.createDataFrame(rows, "num long, words binary")
    placed = spark.createDataFrame([(k, 249, k) for k in range(len(rows))], "num long, n int, root long")
    compared, plain = [], neardup._units
    monkeypatch.setattr(neardup, "_units", lambda lists: compared.extend(m.num for r in lists.collect() for m in r.members) or plain(lists))
    assert [(r.a, r.b) for r in neardup._rest(words, placed).collect()] == [(0, 60)]
    assert set(compared) == {0, 60}


def test_only_the_words_of_compared_texts_are_dealt_out(spark, monkeypatch):
    rnd = random.Random(4)
    rows = []
    for k in range(0, 2000, 2):
        one = np.array([rnd.randrange(1 << 32) for _ in range(60)], np.uint32)
        rows += [(k, bytearray(one.tobytes())), (k + 1, bytearray(np.delete(one, 30).tobytes()))]
    words = spark.createDataFrame(rows, "num long, words binary")
    pairs = neardup.written(spark.createDataFrame([(0, 1), (4, 5), (6, 9)], "a long, b long"))
    dealt, of = [], neardup._of_wanted
    monkeypatch.setattr(neardup, "_of_wanted", lambda *args: dealt.append(of(*args).count()) or of(*args))
    assert sorted((r.a, r.b) for r in neardup._verified(pairs, words).collect()) == [(0, 1), (4, 5)]
    assert 6 <= dealt[0] <= 12


def test_marks_are_little_more_than_a_byte_a_word_and_count_what_is_common():
    rnd = np.random.default_rng(6)
    for n in (1, 5, 300, 5000):
        a = rnd.choice(rnd.integers(0, 1 << 32, max(1, n // 2), np.uint64), n).astype(np.uint32)
        b = np.concatenate([a[: n // 2], rnd.integers(0, 1 << 32, n - n // 2, np.uint64).astype(np.uint32)])
        x, y = neardup._marks(a).tobytes(), neardup._marks(b).tobytes()
        common = neardup._common([neardup._unmarked(x, n), neardup._unmarked(y, n)])
        true = sum(min((a == v).sum(), (b == v).sum()) for v in set(a.tolist()))
        assert len(neardup._unmarked(x, n)) == n and true <= common[0, 1] <= true + 0.1 * n + 1
    assert len(x) <= 1.1 * n


def test_equal_words_have_equal_hashes_wherever_they_stand():
    rnd = random.Random(2)
    words = [bytes(rnd.choice(b"abc01\xc3\xa4") for _ in range(rnd.randrange(1, 7))) for _ in range(30_000)]
    words += [b"z" * 70_000, b"q", b"z" * 70_000, b"q"]
    found = {}
    assert all(found.setdefault(w, h) == h for w, h in zip(words, neardup.hashed(words).tolist(), strict=True))
    assert len(set(found.values())) == len(found) and neardup.hashed([b"q"])[0] == found[b"q"] and not len(neardup.hashed([]))


def test_prefixes_are_the_rarest_by_one_order():
    rnd = np.random.default_rng(7)
    h = np.unique(rnd.integers(0, 1 << 63, 4000, np.uint64) << np.uint64(1))
    often = rnd.integers(0, 5, neardup.SLOTS)
    order = neardup._order(often)
    rank = order[0][neardup._slot(h)]
    assert (np.diff(often[order[1].astype(np.int64)]) >= 0).all()
    for first in (1, 77, len(h) - 1, len(h), len(h) + 3):
        assert set(neardup._rarest(h, order, first).tolist()) == set(h[np.lexsort((h, rank))[:first]].tolist())
