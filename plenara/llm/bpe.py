"""Byte-pair encoding by backtracking over longest matches, and decoding through an offset table.

A piece of text is encoded without applying merges one by one: an Aho-Corasick automaton over
the vocabulary gives the longest token that starts at each byte; tokens are laid left to right,
and one is accepted only if the pair it forms with the token before it is one that merging would
leave standing. A token that fits nowhere is shortened to its next longest prefix; if none is
left, the last token is taken back and its end is marked as dead. Each end is marked once at
most, which makes the work linear in the piece.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Callable
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenara.llm.common import add_columns, table

#: Fixed value: the pattern with which byte-level vocabularies of this family split text.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bounds of what a Python worker remembers: pieces of at most so many letters, so many of them, and pairs of tokens.
LONGEST_KEPT = 64
PIECES_KEPT = 150_000
PAIRS_KEPT = 300_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file: printable Latin-1 for itself, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def token_bytes(spec: dict) -> dict[int, bytes]:
    """The bytes of each id of a vocabulary file, special tokens included."""
    letters = byte_letters()
    raw = {i: bytes(letters[c] for c in name) for name, i in spec["model"]["vocab"].items() if all(c in letters for c in name)}
    return raw | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}


class OffsetTable:
    """All tokens' bytes in a row, and where each id's bytes start: all that decoding needs."""

    def __init__(self, path: str) -> None:
        raw = token_bytes(json.load(open(path, encoding="utf-8")))
        self.size = max(raw) + 1
        parts = [raw.get(i, b"") for i in range(self.size)]
        self.blob = np.frombuffer(b"".join(parts), np.uint8)
        self.offset = np.cumsum([0, *map(len, parts)], dtype=np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids, gathered through the offsets; unknown ids have none."""
        out = []
        for at in range(0, len(ids), 1 << 18):
            x = ids[at : at + (1 << 18)].astype(np.int64)
            x = x[(x >= 0) & (x < self.size)]
            size = self.offset[x + 1] - self.offset[x]
            ends = np.cumsum(size)
            if len(x):
                out.append(self.blob[np.repeat(self.offset[x] - ends + size, size) + np.arange(ends[-1])].tobytes())
        return b"".join(out)


class Vocabulary:
    """A vocabulary file of the tokenizers library (byte-level BPE without a normalizer), ready to encode."""

    def __init__(self, path: str) -> None:
        from tokenizers.pre_tokenizers import ByteLevel

        spec = json.load(open(path, encoding="utf-8"))
        ids, raw = spec["model"]["vocab"], token_bytes(spec)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # tokens are numbered by the merge that makes them, single bytes first
        merges = [m if isinstance(m, list) else m.split(" ", 1) for m in spec["model"]["merges"]]
        order = [i for i in raw if len(raw[i]) == 1 and i not in self.special.values()]
        self.rank = {i: n for n, i in enumerate(order)}
        self.joined: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int]] = [(n, n) for n in range(len(order))]
        for left, right in merges:
            made = ids[left + right]
            pair = (self.rank[ids[left]], self.rank[ids[right]])
            if made in self.rank:
                raise ValueError("two merges make the same token")
            self.rank[made] = self.joined[pair] = len(order)
            order.append(made)
            self.halves.append(pair)
        self.ids = np.array(order, np.int32)
        self.text = [raw[i].decode("latin-1") for i in order]
        self.length = [len(t) for t in self.text]
        self.number = {t: n for n, t in enumerate(self.text)}
        self.automaton = ahocorasick.Automaton()
        for t, n in self.number.items():
            self.automaton.add_word(t, n)
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        self.fits: dict[int, bool] = {}  # by left << 20 | right
        self.split = regex.compile(SPLIT)
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.classes = ByteLevel(add_prefix_space=False)
        self.known: set[str] = set(map(chr, range(128)))
        self.stand_in: dict[int, str] = {}
        self.kept = _Pieces(self)

    def prefix(self, token: int) -> int:
        """The longest token that is a proper prefix, or -1."""
        got = self.shorter.get(token)
        if got is None:
            t = self.text[token]
            got = self.shorter[token] = next((self.number[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.number), -1)
        return got

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' bytes leaves exactly these two tokens.

        The merges are undone from the latest; at each step no merge across the border may
        come before the one that was undone last. Answers are kept in the pair table.
        """
        known = self.fits.get(left << 20 | right)
        if known is not None:
            return known
        a, b, before, answer = left, right, len(self.halves), True
        while True:
            across = self.joined.get((a, b))
            if across is not None and across < before:
                answer = False
                break
            inner_a, inner_b = self.halves[a][1] != a, self.halves[b][0] != b
            if not inner_a and not inner_b:
                break
            if inner_a and (a > b or not inner_b):
                before, a = a, self.halves[a][1]
            else:
                before, b = b + 1, self.halves[b][0]
        if len(self.fits) >= PAIRS_KEPT:
            self.fits.clear()
        self.fits[left << 20 | right] = answer
        return answer

    def encode_piece(self, piece: str) -> list[int]:
        """Token numbers (by merge) of one piece, given as Latin-1 letters of its bytes."""
        n = len(piece)
        best = [-1] * n
        length = self.length
        for end, token in self.automaton.iter(piece):
            best[end + 1 - length[token]] = token  # ends grow, so the longest comes last
        alive = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, best[0] if n else -1
        while at < n:
            end = at + length[token]
            if alive[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                token = best[at] if at < n else -1
                continue
            token = self.prefix(token)
            if token < 0:
                alive[at] = 0
                token = out.pop()
                at -= length[token]
        return out

    def pieces(self, text: str) -> list[str]:
        """The text cut as the library cuts it; letters that only one of the two Unicode tables knows are matched through a stand-in."""
        if not text.isascii():
            for c in set(text) - self.known:
                self.known.add(c)
                theirs = [span for _, span in self.classes.pre_tokenize_str(f"a{c}1")]
                if theirs != [m.span() for m in self.split.finditer(f"a{c}1")]:
                    self.stand_in[ord(c)] = "a" if len(theirs) == 2 and theirs[0][1] == 2 else "1" if len(theirs) == 2 else "!"
            if self.stand_in and any(chr(c) in text for c in self.stand_in):
                return [text[m.start() : m.end()] for m in self.split.finditer(text.translate(self.stand_in))]
        return self.split.findall(text)

    def encode(self, text: str) -> bytes:
        """The ids as consecutive 32-bit integers."""
        if self.parts is None:
            return b"".join(map(self.kept.__getitem__, self.pieces(text)))
        out = []
        for part in self.parts.split(text) if any(s in text for s in self.special) else (text,):
            if part in self.special:
                out.append(np.int32(self.special[part]).tobytes())
            else:
                out += map(self.kept.__getitem__, self.pieces(part))
        return b"".join(out)


class _Pieces(dict):
    """Ids of pieces seen before; long pieces aren't kept, and the table starts anew when full."""

    def __init__(self, of: Vocabulary) -> None:
        self.of = of

    def __missing__(self, piece: str) -> bytes:
        of = self.of
        made = of.ids[of.encode_piece(piece.encode("utf-8", "replace").decode("latin-1"))].tobytes()
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= PIECES_KEPT:
                self.clear()
            self[piece] = made
        return made


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def offset_table(path: str) -> OffsetTable:
    return OffsetTable(path)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None, derived: tuple[str, Callable[[np.ndarray, str], tuple]] | None = None) -> DataFrame:
    """`docs` plus `ids array<int>`, the token ids of each whole text, and if `decoded` names a column, what they decode to.

    `path` is a vocabulary file that every executor has. Null and empty texts have no ids and
    decode to an empty text; a special token's string in a text is that token. Rows, repeated
    ones too, are independent; existing columns of these names are replaced. Decoding in the
    same pass spares a second Python worker and the ids' way there. `derived` is for what needs
    the ids and the decoded text only to compute something small: the columns that it names, and
    a function of both that gives a row's values, come instead of ids and texts, of which neither goes back to the JVM.
    """
    if derived is not None:

        def small():
            v, table_, none = vocabulary(path), offset_table(path), np.zeros(0, np.int32)
            coded = lambda t: np.frombuffer(v.encode(t), np.int32) if t else none
            return lambda texts: list(zip(*(derived[1](x, table_.decode(x).decode("utf-8", "replace")) for x in map(coded, texts)), strict=True))

        return add_columns(docs, [text], derived[0], small, kept=[c for c in docs.columns if c != text])

    def make():
        def work(texts):
            coded = [np.frombuffer(v.encode(t), np.int32) if t else none for t in texts]
            ends = np.cumsum([0, *map(len, coded)], dtype=np.int32)
            out = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([none, *coded])))]
            return out if decoded is None else [*out, [table_.decode(c).decode("utf-8", "replace") for c in coded]]

        v, table_, none = vocabulary(path), decoded and offset_table(path), np.zeros(0, np.int32)
        return work

    return add_columns(docs, [text], f"`{ids}` array<int>" + (f", `{decoded}` string" if decoded else ""), make)


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """`docs` plus `decoded`, the text of each row's ids; bytes that aren't UTF-8 become U+FFFD.

    Null or no ids give an empty text; null or unknown ids add nothing to it.
    """

    def make():
        def work(lists):
            ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            ends = np.cumsum([0, *lists.value_lengths().fill_null(0).to_pylist()])
            return [[t.decode(ids[a:b]).decode("utf-8", "replace") for a, b in itertools.pairwise(ends)]]

        t = offset_table(path)
        return work

    return add_columns(docs, [ids], f"`{text}` string", make, arrow=True)


def ids_digest(ids: str = "ids") -> Column:
    return F.sha2(F.concat_ws(",", F.col(ids).cast("array<string>")), 256)


def digests(ids: np.ndarray, decoded: str) -> tuple[int, str, str]:
    """How many ids there are, and the digests of ids and text, as `ids_digest` and sha2 give them."""
    return len(ids), hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_bpe_roundtrip(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """Encode and decode every whole text of `documents`; see the README's contract table."""
    path = path or default_path()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, path, derived=("n_tokens long, ids_sha256 string, decoded_sha256 string", digests))
