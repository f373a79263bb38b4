"""Encoding whole texts with a public tokenizer, unit by unit.

A unit is a run of white space with the run of other characters after it. Both supported kinds of
tokenizer cut before white space, so a text's ids are its units' ids one after the other, and
each frequent unit is encoded once. Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import json
import os
import re
import struct
from itertools import pairwise

import numpy as np

from tidemark.llm import kernels, piece_table

#: A cached piece takes some 200 bytes of a worker, one of the piece table some 70; a full cache is emptied.
CACHE_UNITS = 200_000
CACHE_PIECES = 1_300_000
CACHE_LONGEST = 48

#: The characters with the Unicode property White_Space.
WHITE = r"\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNITS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: A word with marks after it, whose ids are those of its pieces: both kinds of tokenizer cut there.
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_SPLIT = re.compile(f"(\n?)( ?[{_LATIN}]+)([.,;:!?]*)")
_MARKS = ".,;:!?"
_ASCII_MARKS = r"!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~"  # all but the apostrophe, which some tokenizers cut in words of their own
_PLAIN = re.compile(rf"[{_LATIN}0-9{_ASCII_MARKS} \t\n]*")
_CUT_DROP = re.compile(rf"[{_LATIN}]+|[0-9]|[{_ASCII_MARKS}]+")
_CUT_KEEP = re.compile(rf" ?[{_LATIN}]+| ?[0-9]+| ?[{_ASCII_MARKS}]+|\s+(?!\S)|\s+")


_KINDS = piece_table.classes(
    *("".join(c for c in map(chr, range(128)) if re.fullmatch(f"[{x}]", c)) for x in (_LATIN, "0-9", _ASCII_MARKS, r" \t\n"))
)
_PLAIN_BYTES = bytes(b for b in range(128) if _PLAIN.fullmatch(chr(b)))


def _is_plain(text: str) -> bool:
    """Latin letters, digits, marks and white space only."""
    return not text.encode().translate(None, _PLAIN_BYTES) if text.isascii() else _PLAIN.fullmatch(text) is not None


def _strings(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[str]:
    return [buf[i:j].tobytes().decode() for i, j in zip(start.tolist(), (start + size).tolist(), strict=True)]


class Encoder:
    """Made on an executor from the tokenizer file's text; `vocab` decides the width of stored ids."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True
        self.drops_space = not keeps_space(spec)
        self.units: dict = {}
        self.pieces: dict[str, bytes] = {}
        vocab = self.tokenizer.get_vocab()
        self.edge = [False] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.edge[i] = token.endswith("</w>") if self.drops_space else token.startswith("\u0120")
        self.table = piece_table.Table()
        self._batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.pieces) + self.table.n // 2 > CACHE_PIECES:  # a piece of the table takes a third of one here
            self.pieces.clear()
        out: list[bytes] = [b""] * len(texts)
        plain, rest = [], []
        for i, t in enumerate(texts):
            if t:
                (plain if _is_plain(t) else rest).append(i)
        if plain:  # Latin letters, marks and white space: cut as the tokenizer does, whole pieces
            find = _CUT_DROP.findall if self.drops_space else _CUT_KEEP.findall
            cut = [find(texts[i].lower() if self.drops_space else texts[i]) for i in plain]
            extra = self._encode_pieces(set().union(*cut).difference(self.pieces))
            get = self.pieces.__getitem__ if not extra else lambda p: self.pieces[p] if p in self.pieces else extra[p]
            for i, pieces in zip(plain, cut, strict=True):
                out[i] = b"".join(map(get, pieces))
        if rest:
            for i, ids in zip(rest, self._encode_units([texts[i] for i in rest]), strict=True):
                out[i] = ids
        return out

    def encode_batch(self, texts: kernels.Batch) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each text has.

        Where white space is kept, the pieces of plain texts are cut and looked up in numpy; other texts and long pieces are encoded as above.
        """
        if self.drops_space:
            raw = self.encode([texts.text(i).decode() for i in range(texts.n)])
            return np.frombuffer(b"".join(raw), "<u4"), np.array([len(x) // 4 for x in raw], dtype=np.int64)
        start, plain = piece_table.cut(texts, _KINDS)
        sizes, out = np.zeros(texts.n, dtype=np.int64), [np.zeros(0, "<u4")]
        for at in range(0, len(start), piece_table.SLAB):
            some = start[at : at + piece_table.SLAB]
            stop = int(start[at + piece_table.SLAB]) if at + piece_table.SLAB < len(start) else len(texts.buf)
            text = np.searchsorted(texts.off, some, side="right") - 1
            ids, count = self._look_up(texts.buf[some[0] : stop], some - some[0], ~plain[text])
            out.append(ids)
            sizes += np.bincount(text, weights=count, minlength=texts.n).astype(np.int64)
        return np.concatenate(out), sizes

    def _look_up(self, buf: np.ndarray, start: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces that begin at `start`, and how many each has; of a text that is not plain the piece is the whole text."""
        if self.table.n > piece_table.MOST:
            self.table.clear()
        size = np.diff(start, append=len(buf))
        short = np.flatnonzero(~whole & (size <= piece_table.LONGEST))
        low, high = piece_table.keys(buf, start[short], size[short])
        found, number, hit = self.table.find(low, high)
        missing = np.flatnonzero(~hit)
        while len(missing):  # digests tell new pieces apart; one that shares another's has its turn later
            _, some = np.unique(piece_table.digest(low[missing], high[missing]), return_index=True)
            some = missing[some]
            new = _strings(buf, start[short[some]], size[short[some]])
            ids = self._encode_all(set(new))
            raw = [ids[p] for p in new]
            self.table.add(low[some], high[some], np.frombuffer(b"".join(raw), "<u4"), np.array([len(x) // 4 for x in raw], dtype=np.int64))
            found[missing], number[missing], hit = self.table.find(low[missing], high[missing])
            missing = missing[~hit]
        first, count = np.zeros(len(start), dtype=np.int64), np.zeros(len(start), dtype=np.int64)
        first[short], count[short] = found, number
        alone = np.flatnonzero(whole | (size > piece_table.LONGEST))
        raw = self.encode(_strings(buf, start[alone], size[alone]))
        count[alone] = [len(x) // 4 for x in raw]
        ends = np.cumsum(count)
        out = self.table.ids.take(np.repeat(first - ends + count, count) + np.arange(ends[-1]), mode="clip")
        for at, ids in zip((ends - count)[alone].tolist(), raw, strict=True):
            out[at : at + len(ids) // 4] = np.frombuffer(ids, "<u4")
        return out, count

    def _encode_units(self, texts: list[str]) -> list[bytes]:
        if self.drops_space:
            split = [t.encode().split() for t in texts]
        else:
            split = [_UNITS.findall(t) for t in texts]
        known = self.units
        if len(known) > CACHE_UNITS:
            known.clear()
        new = list(set().union(*split).difference(known)) if split else []
        plain = (b"\n".join(new).decode().split("\n") if new else []) if self.drops_space else new
        pieces, drops = self.pieces, self.drops_space
        words = [u.rstrip(_MARKS) for u in plain]
        lower = "\n".join(words).lower().split("\n") if drops else list(words)
        rest: dict[int, tuple[str, ...]] = {}
        for i, (word, unit) in enumerate(zip(words, plain, strict=True)):
            if not (word.isascii() and (word.isalpha() if drops else word[:1] == " " and word[1:].isalpha())):
                rest[i] = self._parts(unit)
                lower[i] = ""
        missing = set(lower)
        missing.update(unit[len(word) :] for word, unit in zip(words, plain, strict=True))
        missing.update(p for x in rest.values() for p in x)
        extra = self._encode_pieces(missing.difference(pieces, [""]))
        if extra:
            have = extra | {p: pieces[p] for p in missing if p in pieces}
        else:
            have = pieces
        for i, (unit, plain_unit, word, low) in enumerate(zip(new, plain, words, lower, strict=False)):
            if not low:
                known[unit] = b"".join([have[p] for p in rest[i]])
            elif len(word) == len(plain_unit):
                known[unit] = have[low]
            else:
                known[unit] = have[low] + have[plain_unit[len(word) :]]
        get = known.__getitem__
        out = [b"".join(map(get, units)) for units in split]
        for unit in new:
            if len(unit) > CACHE_LONGEST:
                del known[unit]
        return out

    def _encode_pieces(self, missing: set[str]) -> dict[str, bytes]:
        """Encodes pieces; short ones go to the cache, the ids of longer ones are returned."""
        ids = self._encode_all(missing)
        extra = {p: x for p, x in ids.items() if len(p) > CACHE_LONGEST}
        for p in extra:
            del ids[p]
        self.pieces.update(ids)
        return extra

    def _encode_all(self, missing: set[str]) -> dict[str, bytes]:
        """The ids of pieces.

        Words are encoded many at a time: where white space is dropped, a word's last id ends with the word-end mark; where it
        is kept, the first id of a word after one space begins with the space. The cuts are counted before they are trusted.
        """
        out: dict[str, bytes] = {}
        if self.drops_space:
            simple = [p for p in missing if p.isalpha() and len(p) <= CACHE_LONGEST]
        else:
            simple = [p for p in missing if p[0] == " " and p[1:].isalpha() and len(p) <= CACHE_LONGEST]
        alone = list(missing.difference(simple))
        glue = " " if self.drops_space else ""
        groups = [simple[at : at + 64] for at in range(0, len(simple), 64)]
        edge = self.edge
        for group, e in zip(groups, self._batch([glue.join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = e.ids
            cuts = [i for i, x in enumerate(ids) if edge[x]]
            cuts = [0, *(i + 1 for i in cuts)] if self.drops_space else [*cuts, len(ids)]
            if len(cuts) != len(group) + 1:
                alone.extend(group)
                continue
            raw = struct.pack(f"<{len(ids)}I", *ids)
            out.update(zip(group, [raw[4 * i : 4 * j] for i, j in pairwise(cuts)], strict=True))
        for at in range(0, len(alone), 4096):
            some = alone[at : at + 4096]
            for piece, e in zip(some, self._batch(some, add_special_tokens=False), strict=True):
                out[piece] = struct.pack(f"<{len(e.ids)}I", *e.ids)
        return out

    def _parts(self, unit: str) -> tuple[str, ...]:
        m = _SPLIT.fullmatch(unit)
        if m is None:
            return (unit,)
        line, word, marks = m.groups()
        if line and word[0] == " ":
            return (unit,)
        word = word.lower() if self.drops_space else word
        return tuple(x for x in (line, word, marks) if x)


def keeps_space(spec: str) -> bool:
    """Whether white space becomes part of ids (byte-level BPE) or is dropped (BPE with word ends)."""
    d = json.loads(spec)
    pre = d.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [pre])
    if d.get("model", {}).get("type") != "BPE" or not any(s.get("type") == "ByteLevel" for s in steps):
        raise ValueError("only byte-level BPE and BPE with word ends are supported")
    if any(s.get("type") == "Split" and s.get("invert") and s.get("behavior") == "Removed" for s in steps):
        return False
    if d.get("normalizer") or any(s.get("add_prefix_space") for s in steps) or not any(s.get("use_regex") for s in steps):
        raise ValueError("a byte-level BPE with its usual cuts and no normalizer is expected")
    return True


def read_spec(path: str, limit: int = 64 << 20) -> str:
    """The tokenizer file's text, read on the driver to be broadcast; its size is checked."""
    if os.path.getsize(path) > limit:
        raise ValueError(f"{path}: larger than {limit} bytes, too large to broadcast")
    with open(path, encoding="utf-8") as f:
        return f.read()


def vocab_size(spec: str) -> int:
    d = json.loads(spec)
    return 1 + max([*d["model"]["vocab"].values(), *(a["id"] for a in d.get("added_tokens", []))])


def encoder(spec: str) -> Encoder:
    """One Encoder for each tokenizer and Python worker."""
    key = ("encoder", len(spec), hash(spec))
    if key not in kernels.cache():
        kernels.cache()[key] = Encoder(spec)
    return kernels.cache()[key]
