"""Near duplicates by Order MinHash, verified by banded alignment.

A text is its sequence of words. Its five-word shingles, each labelled with how often it has
occurred so far, are sketched: a sketch takes the few labelled shingles with the least hashes, in
the order in which they stand in the text, so that two texts agree on it if they share those
shingles in that order, and agreement falls with the edits between them. Texts that agree on a
sketch are compared: they are linked if they share SHARED of the longer one's shingles, and if an
alignment of their words within the band that the threshold leaves open matches SIMILARITY of the
longer text. Sketches of short texts often miss; these share a bucket if they share one of their
least shingles by hash, which linked texts must whatever the order (prefix filtering).

Exact copies (equal words) are one text from the start. Texts with a sketch in common form a
bucket. Each text is compared with the leaders of its buckets, the texts that meet the most others
over all their buckets: in a group of copies that is the one they were made from. Whatever this
leaves in different classes meets by exact prefix filtering: of two linked texts, whichever they
are, each has a shingle of the other among all but SHARED of its own, the rarest first. Texts that
meet there in different classes are all compared, so no link between two classes is lost; a group
of any size costs little more than its members as long as its members are of one class.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenara.llm.common import add_columns, checkpointed, give_back, release, swept, table, without, written
from plenara.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
#: The share of the longer text's shingles that linked texts have in common.
SHARED = 0.4
#: Linked texts share prefix shingles beyond the first: so large a share of the shorter one's shingles, if prefixes are longer by it.
MORE = 0.1
#: The share from which texts count as close; the search makes no difference between these and other linked ones.
CLOSE = 0.85
#: Sketches of a text, and shingles in a sketch. Texts of which a tenth of the words differ, here and there, share
#: three fifths of their shingles and miss all sketches once in forty times; those that share half, one time in six.
SKETCHES, IN_SKETCH = 48, 3
#: Shingles up to which a text meets all that may be linked to it by exact prefixes.
SHORT = 32
#: Slots in which shingles are counted to tell rare from frequent ones; the counts are all that is broadcast (8 bytes each).
SLOTS = 1 << 18
#: Ranges of slots in which tasks hand on their counts.
_RANGES = 64
#: Hashes that are mixed for sketches at once.
_AT_ONCE = 1 << 20
#: Prefix shingles that a task packs at once, and those aimed at in a part in which texts meet.
_PACKED, _IN_PART = 1 << 20, 1 << 17
#: Texts (as many as a mask has bits) and words of a block; of a list that is larger, blocks are compared two at a time.
_BLOCK, _BLOCK_WORDS = 64, 1 << 21
#: Earlier lists of a text by which it is seen that two have met: the nearest, and the first.
_NEAREST, _FIRST = 6, 10
#: Bits of the table that says which texts may be compared at all.
_WANTED = 1 << 24
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
#: Letters that are hashed at once.
_LETTERS = 1 << 16
_rng = np.random.default_rng(20240607)
_ADD = _rng.integers(0, 1 << 63, (SKETCHES, 1), np.uint64)
_TIMES = _rng.integers(0, 1 << 63, (SKETCHES, 1), np.uint64) | np.uint64(1)
#: A number for each byte, none for the gap; powers of a base, and of its inverse, modulo 2^64.
_LETTER = _rng.integers(1, 1 << 63, 256, np.uint64)
_LETTER[32] = 0
_BASE = 0x9E3779B97F4A7C15
_POWER = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(_LETTERS - 1, _BASE, np.uint64)]))
_FURTHER, _BACK = pow(_BASE, _LETTERS, 1 << 64), pow(_BASE, -_LETTERS, 1 << 64)
_INVERSE = np.multiply.accumulate(np.full(_LETTERS, pow(_BASE, -1, 1 << 64), np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


def words_of(text: str) -> list[bytes]:
    """Lower-cased words; every ASCII sign but letters and digits is a gap."""
    return text.lower().encode("utf-8", "replace").translate(_FOLD).split()


def hashed(words: list[bytes]) -> np.ndarray:
    """A hash of each word: the sum of its letters' numbers times powers of a base by their place, mixed. Sums are running ones over all letters."""
    if not words:
        return np.zeros(0, np.uint64)
    text = np.frombuffer(b" ".join(words), np.uint8)
    sums, unshift, total, scale, unscale, whole = [], [np.ones(1, np.uint64)], np.zeros(1, np.uint64), 1, 1, 1 << 64
    for at in range(0, len(text), _LETTERS):
        part = text[at : at + _LETTERS]
        running = np.cumsum(_LETTER.take(part) * _POWER[: len(part)])
        if at:
            running = running * np.uint64(scale) + total
        gaps = np.flatnonzero(part == 32)
        sums.append(running[gaps])
        unshift.append(_INVERSE[gaps] * np.uint64(unscale))
        total, scale, unscale = running[-1:], scale * _FURTHER % whole, unscale * _BACK % whole
    ends = np.concatenate([*sums, total])
    return _mixed(_mixed(np.diff(ends, prepend=np.uint64(0)) * np.concatenate(unshift)))


def labelled(h: np.ndarray) -> np.ndarray:
    """Hashes of (value, how often it has occurred so far): all are different."""
    sorted_ = np.sort(h)
    if not (sorted_[1:] == sorted_[:-1]).any():
        return h
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    at = np.arange(len(h))
    first = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), at, 0))
    label = np.empty(len(h), np.uint64)
    label[order] = (at - first).astype(np.uint64)
    return np.where(label > 0, _mixed(h + label * _STEP), h)


def shingles(w: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the labelled shingles of hashed words in text order; a shorter text is one shingle, one without words has none."""
    if not len(w):
        return np.zeros(0, np.uint64)
    n = max(1, len(w) - size + 1)
    h = np.full(n, min(size, len(w)), np.uint64)
    for k in range(min(size, len(w))):
        h = h * _MIX + w[k : k + n] * _STEP
    return labelled(_mixed(_mixed(h)))


def sketches(h: np.ndarray) -> np.ndarray:
    """Order MinHash: SKETCHES values, each of the IN_SKETCH least shingles under its own hash, in text order."""
    out = np.arange(1, SKETCHES + 1, dtype=np.uint64)
    take = min(IN_SKETCH, len(h))
    step = max(1, _AT_ONCE // max(1, len(h)))
    for at in range(0, SKETCHES, step):
        x = (h[None, :] ^ _ADD[at : at + step]) * _TIMES[at : at + step]
        rows = np.arange(len(x))
        least = np.empty((len(x), take), np.int64)
        for k in range(take):
            least[:, k] = x.argmin(axis=1)
            x[rows, least[:, k]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        least.sort(axis=1)
        for k in range(take):
            out[at : at + step] = _mixed(out[at : at + step] * _STEP + h[least[:, k]])
    return out


def prefix(n: int, share: float = SHARED) -> int:
    """How many of a text's n shingles, in any order that all texts have in common, hold one of every text that shares so many of them."""
    return n - math.ceil(share * n - 1e-6) + 1


def more(n: int) -> int:
    """How many shingles a text's prefix is longer, so that it holds as many more of every text that it is linked to (of a shorter one: as that one's prefix is longer)."""
    return math.ceil(MORE * n - 1e-6) - 1


def _met_at_least(n: Column) -> Column:
    """How many of its prefix shingles a text of `n` words shares at least with any that it is linked to; one less, for shingles that agree in the bits that are kept."""
    shorter = F.greatest(F.ceil(SIMILARITY * n - 1e-6) - (SHINGLE - 1), F.lit(1))
    return F.greatest(F.ceil(MORE * shorter - 1e-6) - 1, F.lit(1))


def buckets(h: np.ndarray) -> np.ndarray:
    """What texts meet by: sketches of those above SHORT shingles, prefixes of those up to SHORT and of those that may be linked to one."""
    out = [sketches(h)] if len(h) > SHORT else []
    if SIMILARITY * (len(h) + SHINGLE - 1) <= SHORT + SHINGLE - 1 + 1e-6:
        mixed = np.sort(_mixed(h * _STEP))
        out.append(mixed[: prefix(len(h))])
    return np.concatenate(out)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two texts of hashed words share enough shingles and align."""
    if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)) - 1e-6:
        return False
    x, y = shingles(a.astype(np.uint64)), shingles(b.astype(np.uint64))
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common >= SHARED * max(len(x), len(y)) - 1e-6 and aligned(a, b)


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether an alignment matches at least `least` of the longer sequence.

    A text with enough matches strays from the diagonal by no more than the insertions and
    deletions it can afford; matches outside that band don't count. What both texts begin and
    end with is matched first, and the longest common subsequence of the rest, within the band,
    comes from bit rows: one addition a word.
    """
    need = math.ceil(least * max(len(a), len(b)) - 1e-6)
    down, up = len(a) - need, len(b) - need  # deletions and insertions left
    if min(down, up) < 0 or not len(a):
        return False
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b, n = a[head:], b[head:], n - head
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    a, b, need = a[: len(a) - tail], b[: len(b) - tail], need - head - tail
    if need <= 0:
        return True
    if min(len(a), len(b)) < need:
        return False
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    window, free = (1 << (down + up + 1)) - 1, full
    for j, x in enumerate(b.tolist()):
        hit = places.get(x)
        if hit:
            low = j - up
            hit &= (window << low if low >= 0 else window >> -low) & free
            free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count() >= need


def sketched(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` plus `key` (of the words, null if there are none), `n` (words), `words` (32 bits of each word's hash) and `sketches` (and prefixes)."""

    def make():
        def work(texts):
            keys, sizes, kept, found = [], [], [], []
            for t in texts:
                words = words_of(t) if t else []
                h = hashed(words)
                keys.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                sizes.append(len(h))
                kept.append(h.astype(np.uint32).tobytes() if words else None)
                found.append(buckets(shingles(h.astype(np.uint32).astype(np.uint64))).view(np.int64) if words else [])
            return [keys, sizes, kept, found]

        return work

    return add_columns(docs, [text], "key binary, n int, words binary, sketches array<long>", make)


def _wanted(nums: DataFrame) -> np.ndarray:
    """A table of bits, of fixed size, that says which `num` may be among `nums`."""
    bits = np.zeros(_WANTED // 64, np.uint64)
    cells = nums.select(F.shiftright(_slot_of_num(), 6).alias("cell"), F.expr("shiftleft(1L, cast(pmod(xxhash64(num), 64) AS int))").alias("bit"))
    for r in cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).collect():
        bits[r.cell] = r.bits & 0xFFFFFFFFFFFFFFFF
    return bits


def _slot_of_num() -> Column:
    return F.pmod(F.xxhash64("num"), F.lit(_WANTED)).cast("int")


def _of_wanted(words: DataFrame, nums: DataFrame, schema: str, make: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """`num` and what `make` makes of `words`, for every num in `nums` and few more; nothing else is dealt out."""
    bits = _wanted(nums)
    names = ["num", *T.DataType.fromDDL(schema).fieldNames()]

    def run(batches):
        for batch in batches:
            at = batch.column(2).to_numpy()
            there = pa.array(np.flatnonzero((bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(there), *make(batch.column(1).take(there))], names=names)

    return words.select("num", "words", _slot_of_num().alias("slot")).mapInArrow(run, f"num long, {schema}")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b), a table that is written, whose texts are linked."""
    texts = _of_wanted(texts, pairs.select(F.explode(F.array("a", "b")).alias("num")), "words binary", lambda words: [words])
    side = lambda c: texts.select(F.col("num").alias(c), F.col("words").alias(f"{c}_words"))
    with_words = pairs.join(side("a"), "a").join(side("b"), "b")

    def make():
        of = lambda x: np.frombuffer(x, np.uint32)
        return lambda a, b: [[linked(of(x), of(y)) for x, y in zip(a, b, strict=True)]]

    return add_columns(with_words, ["a_words", "b_words"], "near boolean", make).where("near").select("a", "b")


def _of_words(words: bytes) -> np.ndarray:
    return shingles(np.frombuffer(words, np.uint32).astype(np.uint64))


def _slot(shingle: np.ndarray) -> np.ndarray:
    return (shingle >> np.uint64(64 - (SLOTS - 1).bit_length())).astype(np.int64)


def _frequencies(texts: DataFrame) -> np.ndarray:
    """How many labelled shingles of all `texts` fall into each slot, summed task by task in ranges of slots."""

    def run(batches):
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for words in batch.column(0).to_pylist():
                np.add.at(total, _slot(_of_words(words)), 1)
        parts = [x.tobytes() for x in total.reshape(_RANGES, -1) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, x in enumerate(total.reshape(_RANGES, -1)) if x.any()], pa.int32()), pa.array(parts, pa.binary())], names=["range", "counts"])

    def add(part):
        counts = sum(np.frombuffer(c, np.int64) for c in part.column("counts").to_pylist())
        return pa.table([part.column("range").slice(0, 1), pa.array([counts.tobytes()], pa.binary())], names=["range", "counts"])

    out = np.zeros((_RANGES, SLOTS // _RANGES), np.int64)
    for r in texts.select("words").mapInArrow(run, "range int, counts binary").groupBy("range").applyInArrow(add, "range int, counts binary").collect():
        out[r.range] = np.frombuffer(r.counts, np.int64)
    return out.ravel()


def _order(often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each slot, rare ones first, and the slot of each rank."""
    slots = np.argsort(often, kind="stable").astype(np.uint64)
    rank = np.empty(SLOTS, np.uint64)
    rank[slots.astype(np.int64)] = np.arange(SLOTS, dtype=np.uint64)
    return rank, slots


def _rarest(h: np.ndarray, order: tuple[np.ndarray, np.ndarray], first: int) -> np.ndarray:
    """The `first` of all different `h`, by the rank of their slot, then by the bits below."""
    if first >= len(h):
        return h
    rank, slots = order
    below = np.uint64(64 - (SLOTS - 1).bit_length())
    rest = (np.uint64(1) << below) - np.uint64(1)
    key = np.partition(rank[_slot(h)] << below | h & rest, first - 1)[:first]
    return slots[(key >> below).astype(np.int64)] << below | key & rest


def _packed(h: np.ndarray, at: np.ndarray, bits: int) -> list[tuple[int, int, bytes]]:
    """(part, count, data) of shingles and the small numbers `at` of their texts: parts are of the first `bits`, the next 32 are kept, as differences, in planes of bytes."""
    order = np.argsort(h)
    h, at = h[order], at[order].astype(np.uint16)
    part = (h >> np.uint64(64 - bits)).astype(np.int64)
    low = (h >> np.uint64(32 - bits)).astype(np.uint32)
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
    out = []
    for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        steps = np.diff(low[x:y], prepend=np.uint32(0))
        data = steps.view(np.uint8).reshape(-1, 4).T.tobytes() + at[x:y].view(np.uint8).reshape(-1, 2).T.tobytes()
        out.append((int(part[x]), y - x, pa.compress(data, codec="zstd", asbytes=True)))
    return out


def _unpacked(count: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(data, 6 * count, codec="zstd", asbytes=True), np.uint8)
    steps = np.ascontiguousarray(raw[: 4 * count].reshape(4, count).T).view(np.uint32).ravel()
    at = np.ascontiguousarray(raw[4 * count :].reshape(2, count).T).view(np.uint16).ravel()
    return np.cumsum(steps, dtype=np.uint32), at.astype(np.int64)


def _lists(texts: DataFrame) -> DataFrame:
    """(id, members, weight): all different lists of two or more texts that have a prefix shingle in common, and how many they have.

    Shingles are in one order for all texts: by the rank of their slot's count, then by hash. Of a text's
    first `prefix` shingles any linked text has one among its own first; prefixes are longer by `more`, so that it has
    as many more of them. They are packed before
    they are dealt out, as most of them stand in one text only; those that agree in 40 bits or
    more count as one, which at most makes a list longer.
    """
    often = _frequencies(texts)
    bits = min(12, max(8, int(often.sum() * (1 - SHARED + MORE) / _IN_PART).bit_length()))
    order = _order(often)

    def pack(batches):
        base, count, hs, ats = 0, 0, [], []

        def flush():
            found = _packed(np.concatenate(hs), np.concatenate(ats), bits)
            return pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int32()), pa.array([base] * len(found), pa.int64()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.binary())],
                names=["part", "base", "count", "data"],
            )

        for batch in batches:
            for num, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if hs and not (count < _PACKED and 0 <= num - base < 1 << 16):
                    yield flush()
                    hs.clear()
                    ats.clear()
                if not hs:
                    base, count = num, 0
                h = _of_words(words)
                h = _rarest(h, order, prefix(len(h)) + more(len(h)))
                hs.append(h)
                ats.append(np.full(len(h), num - base, np.int64))
                count += len(h)
        if hs:
            yield flush()
        give_back()

    def meet(part):
        lows, nums = [], []
        for base, count, data in zip(*(part.column(c).to_pylist() for c in ("base", "count", "data")), strict=True):
            low, at = _unpacked(count, data)
            lows.append(low)
            nums.append(at + base)
        low, num = np.concatenate(lows), np.concatenate(nums)
        order = np.lexsort((num, low))
        low, num = low[order], num[order]
        fresh = np.concatenate([[True], (low[1:] != low[:-1]) | (num[1:] != num[:-1])])
        low, num = low[fresh], num[fresh]
        cuts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1], [True]]))
        several = np.flatnonzero(np.diff(cuts) > 1)
        found, weight = {}, Counter()
        for x, y in zip(cuts[several].tolist(), cuts[several + 1].tolist(), strict=True):
            members = num[x:y]
            id = xxhash.xxh3_128_digest(members.tobytes())
            found.setdefault(id, members)
            weight[id] += 1
        flat = np.concatenate([*found.values(), np.zeros(0, np.int64)])
        ends = np.cumsum([0, *map(len, found.values())])
        return pa.table([pa.array(list(found), pa.binary()), pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(flat)).cast(pa.list_(pa.int64())), pa.array([weight[id] for id in found], pa.int64())], names=["id", "members", "weight"])

    packed = texts.select("num", "words").mapInArrow(pack, "part int, base long, count int, data binary")
    met = packed.groupBy("part").applyInArrow(meet, "id binary, members array<long>, weight long")
    return met.groupBy("id").agg(F.first("members").alias("members"), F.sum("weight").alias("weight"))


def _blocks(n: np.ndarray) -> np.ndarray:
    """Block numbers of texts of `n` words each, in their order."""
    out, block, texts, words = [], 0, 0, 0
    for k in n.tolist():
        if texts and (texts >= _BLOCK or words + k > _BLOCK_WORDS):
            block, texts, words = block + 1, 0, 0
        out.append(block)
        texts, words = texts + 1, words + k
    return np.array(out)


def _apart(may: np.ndarray, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """`may` without the cells whose two sets, one of `a` and one of `b`, have an item in common."""
    x, y = np.nonzero(may)
    if len(x) <= _BLOCK:
        left, right = {k: set(a[k].tolist()) for k in set(x.tolist())}, {k: set(b[k].tolist()) for k in set(y.tolist())}
        out = np.zeros_like(may)
        out[x, y] = [left[k].isdisjoint(right[m]) for k, m in zip(x.tolist(), y.tolist(), strict=True)]
        return out
    return may & (_common([*a, *b])[: len(a), len(a) :] == 0)


def _units(lists: DataFrame) -> DataFrame:
    """What is compared together: (list, i, j, block, at, num, mask) for blocks i and j of each list of `members`.

    Members are (num, n, root, before); a field `earlier`, if there is one, names other lists that a
    text stands in before this one. Texts with an earlier list in common have met there. `at` is the
    text's place in its block; bits of `mask` say with which places of block j a text of block i is compared.
    """

    def run(batches):
        for batch in batches:
            flat = batch.column(1).flatten()
            num, n, root, before = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("num", "n", "root", "before"))
            known = flat.type.get_field_index("earlier") >= 0
            if known:
                items = flat.field("earlier").flatten().to_numpy(zero_copy_only=False)
                starts = np.cumsum([0, *flat.field("earlier").value_lengths().to_pylist()])
            ends = np.cumsum([0, *batch.column(1).value_lengths().to_pylist()]).tolist()
            rows = [[] for _ in range(7)]
            for one, x, y in zip(batch.column(0).to_pylist(), ends[:-1], ends[1:], strict=True):
                values, own, size = np.unique(root[x:y], return_inverse=True, return_counts=True)
                # texts of a large class stand together, so that its blocks are left alone among themselves
                order = np.lexsort((n[x:y], np.where(size[own] >= _BLOCK, own, len(values)), -np.where(size[own] >= _BLOCK, size[own], 0))) + x
                block = _blocks(n[order])
                inside = [order[block == k] for k in range(block[-1] + 1)]
                for i, a in enumerate(inside):
                    for j, b in enumerate(inside[i:], i):
                        may = (root[a][:, None] != root[b]) & (before[a][:, None] != before[b]) & (np.minimum(n[a][:, None], n[b]) >= SIMILARITY * np.maximum(n[a][:, None], n[b]) - 1e-6)
                        if i == j:
                            may = np.triu(may)
                        if known and may.any():
                            may = _apart(may, *([items[starts[k] : starts[k + 1]] for k in of] for of in (a, b)))
                        if not may.any():
                            continue
                        mask = np.zeros((len(a), 64), np.uint8)
                        mask[:, : len(b)] = may
                        mask = np.packbits(mask, axis=1, bitorder="little").view(np.int64).ravel()
                        sides = [(i, a, mask, may.any(axis=1) | may.any(axis=0))] if i == j else [(i, a, mask, may.any(axis=1)), (j, b, np.zeros(len(b), np.int64), may.any(axis=0))]
                        for block_, of, bits, there in sides:
                            at = np.flatnonzero(there)
                            for row, value in zip(rows, ([one] * len(at), [i] * len(at), [j] * len(at), [block_] * len(at), at.tolist(), num[of[at]].tolist(), bits[at].tolist()), strict=True):
                                row += value
            names = ["list", "i", "j", "block", "at", "num", "mask"]
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64() if c in ("list", "num", "mask") else pa.int32()) for r, c in zip(rows, names, strict=True)], names=names)

    return lists.mapInArrow(run, "list long, i int, j int, block int, at int, num long, mask long")


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many items each two of the sets share."""
    values, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    column = np.cumsum(n > 1) - 1
    keep = n[at] > 1
    who, at = who[keep], column[at[keep]]
    order = np.argsort(at, kind="stable")
    who, at = who[order], at[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, 1 << 14):
        x, y = np.searchsorted(at, [low, low + (1 << 14)])
        there = np.zeros((len(sets), 1 << 14), np.float32)
        there[who[x:y], at[x:y] - low] = 1
        out += there @ there.T
    return out


def _marks(words: np.ndarray) -> np.ndarray:
    """16 bits of each word, sorted, as steps from one to the next: a byte each, then two for each of 255 or more."""
    steps = np.diff(np.sort(((words.astype(np.uint64) * _STEP) >> np.uint64(40)).astype(np.uint16)), prepend=np.uint16(0))
    return np.concatenate([np.minimum(steps, 255).astype(np.uint8), steps[steps >= 255].view(np.uint8)])


def _unmarked(marks: bytes, n: int) -> np.ndarray:
    """The sorted 16 bits of `n` words, each with how often it has stood before."""
    raw = np.frombuffer(marks, np.uint8)
    steps = raw[:n].astype(np.uint64)
    steps[steps == 255] = np.frombuffer(raw[n:].tobytes(), np.uint16)
    marks, at = np.cumsum(steps), np.arange(n)
    first = np.maximum.accumulate(np.where(np.diff(marks, prepend=np.uint64(1 << 20)) != 0, at, 0))
    return marks | (at - first).astype(np.uint64) << np.uint64(16)


def _unit_pairs(unit: pa.Table) -> pa.Table:
    """Pairs (a, b) of a unit that may be linked: an alignment leaves out all words that one text has and the other hasn't."""
    num, n, block, at, mask, i, j = (unit.column(c).to_numpy() for c in ("num", "n", "block", "at", "mask", "i", "j"))
    marks = [_unmarked(m, k) for m, k in zip(unit.column("marks").to_pylist(), n.tolist(), strict=True)]
    bits = np.unpackbits(np.ascontiguousarray(mask).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    may = bits[:, at].astype(bool) & (block == i[0])[:, None] & (block == j[0])
    # equal marks are told apart by their number; different words of one mark only add to what is common
    common, least = _common(marks), SIMILARITY * np.maximum(n[:, None], n) - 1e-6
    x, y = np.nonzero(may & (common >= least))
    return pa.table([pa.array(np.minimum(num[x], num[y])), pa.array(np.maximum(num[x], num[y]))], names=["a", "b"])


def _marked(words: pa.Array) -> list[pa.Array]:
    of = [np.frombuffer(w, np.uint32) for w in words.to_pylist()]
    return [pa.array([len(w) for w in of], pa.int32()), pa.array([_marks(w).tobytes() for w in of], pa.binary())]


def _rest(words: DataFrame, placed: DataFrame) -> DataFrame:
    """Links (a, b) that join classes further, found among all texts that `placed` (num, n, root) has in different classes.

    Texts meet in the lists of `_lists`. Two that share several are compared in the first of them only:
    lists are in one order, the longest first, and texts that have stood in an earlier one together
    have met there. A text whose prefix shares fewer shingles with all others than with any it is
    linked to is not looked at further. Of a text's earlier lists the nearest and the first ones are looked at; a pair
    that shares others only is compared again.
    """
    lists = _lists(words).withColumn("list", F.monotonically_increasing_id())
    lists = written(lists.select("list", F.size("members").alias("size"), "weight", "members"))
    rows = lists.select("list", "size", "weight", F.explode("members").alias("num")).join(placed, "num")
    rows = rows.withColumn("shares", F.sum("weight").over(Window.partitionBy("num"))).where(F.col("shares") >= _met_at_least(F.col("n")))
    own = Window.partitionBy("num").orderBy(F.desc("size"), "list")
    first = own.rowsBetween(Window.unboundedPreceding, -1)
    earlier = [F.lag("list", k).over(own) for k in range(1, _NEAREST + 1)] + [F.nth_value("list", k).over(first) for k in range(1, _FIRST + 1)]
    rows = rows.withColumns({"before": F.coalesce(F.lag("list").over(own), -1 - F.col("num")), "earlier": F.array_distinct(F.array_compact(F.array(*earlier)))})
    met = rows.groupBy("list").agg(F.collect_list(F.struct("num", "n", "root", "before", "earlier")).alias("members"), F.min("root").alias("least"), F.max("root").alias("most"), F.min("before").alias("from"), F.max("before").alias("to"))
    units = written(_units(met.where("least < most AND from < to").select("list", "members")))
    release(lists)
    swept(words.sparkSession)
    texts = _of_wanted(words, units.select("num"), "n int, marks binary", _marked)
    pairs = units.join(texts, "num").groupBy("list", "i", "j").applyInArrow(_unit_pairs, "a long, b long")
    pairs = written(pairs.distinct())
    release(units)
    swept(words.sparkSession)
    links = checkpointed(_verified(pairs, words))
    release(pairs)
    return links


def _joined(root: DataFrame, more: DataFrame) -> DataFrame:
    """Roots (node, root) after more links (a, b): what the links join are the classes so far, which are few."""
    if more.isEmpty():
        return root
    of = lambda c: more.select("a", "b").join(root.withColumnRenamed("node", c).withColumnRenamed("root", f"__{c}"), c, "left").select("a", "b", F.coalesce(f"__{c}", c).alias(f"r{c}"))
    classes = components(of("a").join(of("b"), ["a", "b"]).select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    nodes = root.unionByName(more.select(F.col("a").alias("node"), F.col("a").alias("root"))).unionByName(more.select(F.col("b").alias("node"), F.col("b").alias("root")))
    nodes = nodes.groupBy("node").agg(F.min("root").alias("root"))  # a node of its own so far has itself
    met = nodes.join(classes.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    return checkpointed(met.select("node", F.coalesce("top", "root").alias("root")))


def near_classes(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, class_id, class_size) for every row of `docs`; class_id is the least id of its class.

    Texts of equal words are copies; texts that share SHARED of their shingles and align at
    SIMILARITY are linked; classes are what links and copies connect. A text without a word (null, empty, signs only)
    is a class of its own. Repeated rows belong to one class and are each returned; null ids
    are returned as they are and never name a class that has another id. Texts of any length are
    taken whole: sketches are made in parts of bounded size, and alignments keep one bit row.
    """
    docs = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    rows = written(sketched(docs).drop("text"))
    ids = written(rows.select("id", "key"))
    once = [F.first(c).alias(c) for c in ("n", "sketches", "words")]
    texts = rows.where("key IS NOT NULL").groupBy("key").agg(*once, F.min("id").alias("least"), F.count("*").alias("copies"))
    # numbers that follow the written order, fixed from here on
    texts = written(texts.withColumn("num", F.monotonically_increasing_id()))
    release(rows)
    swept(docs.sparkSession)
    words = texts.select("num", "words")
    # what is joined with a bucket's many rows is written first, so that the join is dealt out by
    # itself and can be split where a bucket is large
    members = texts.select("num", "n", F.explode("sketches").alias("sketch"))
    sizes = written(members.groupBy("sketch").agg(F.count("*").alias("size")).where("size > 1"))
    met = members.join(sizes, "sketch").groupBy("num", "n").agg(F.collect_list("sketch").alias("sketches"), F.sum("size").alias("met"))
    met = written(met)
    release(sizes)
    leader = written(met.select("num", "n", "met", F.explode("sketches").alias("sketch")).groupBy("sketch").agg(F.max(F.struct("met", "num", "n")).alias("lead")))
    near_size = lambda x, y: F.least(x, y) >= SIMILARITY * F.greatest(x, y) - 1e-6
    stars = met.select("num", "n", F.explode("sketches").alias("sketch")).join(leader, "sketch")
    stars = stars.where((F.col("num") != F.col("lead.num")) & near_size(F.col("n"), F.col("lead.n")))
    stars = written(stars.select(F.col("lead.num").alias("a"), F.col("num").alias("b")).distinct())
    release(leader, met)
    swept(docs.sparkSession)
    links = checkpointed(_verified(stars, words))
    release(stars)
    # every linked pair that the stars haven't brought into one class
    root = components(links)
    placed = written(texts.select("num", "n").join(root.withColumnRenamed("node", "num"), "num", "left").select("num", "n", F.coalesce("root", "num").alias("root")))
    more = _rest(words, placed)
    release(placed)
    root = _joined(root, more)
    named = texts.select("key", "num", "least", "copies").join(root.withColumnRenamed("node", "num"), "num", "left").withColumn("root", F.coalesce("root", "num"))
    classes = written(named.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size")))
    keyed = written(named.join(classes, "root").select("key", "class_id", "class_size"))
    release(texts, classes)
    alone = F.col("key").isNull()
    out = ids.join(keyed, "key", "left")
    return out.select(F.col("id").alias(id), F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"))


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class of near duplicates, columns unchanged: that of the least id, then of the least text hash.

    Rows without a word stay; null ids count as the greatest. Of rows that repeat the kept one
    in id and text, one stays.
    """
    hash_ = F.xxhash64(F.coalesce(text, F.lit("")))
    rank = F.struct(F.col(id).isNull().alias("none"), F.col(id).alias("id"), hash_.alias("hash"))
    classes = near_classes(docs.select(rank.alias("rank"), F.col(text).alias("text")), "rank")
    kept = classes.where("rank = class_id").select(F.col("rank.id").alias("__id"), F.col("rank.hash").alias("__hash")).distinct()
    marked = without(docs, ["__own"]).withColumn("__own", hash_)
    found = marked.join(kept, (F.col(id).eqNullSafe(F.col("__id"))) & (F.col("__own") == F.col("__hash")), "left_semi")
    once = Window.partitionBy(id, "__own").orderBy("__own")
    worded = F.coalesce(F.regexp_like(text, F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]")), F.lit(False))
    return found.withColumn("__nth", F.row_number().over(once)).where((F.col("__nth") == 1) | ~worded).select(*docs.columns)


def op6_order_minhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of `documents`: doc_id, class_id, class_size; see the README's contract table."""
    return near_classes(table(spark, sf_dir, "documents"))
