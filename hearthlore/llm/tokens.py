"""Byte-level BPE with the tokenizers library, a cached word at a time.

Pre-tokens of the byte-level pattern never reach across a space that stands between
two other characters, so a text is the concatenation of its space-separated units and
each unit needs to be merged only once per Python worker. The merging itself is the
library's; a unit's identifiers are kept as little-endian bytes. ``encode_rows`` takes texts
together, finds their distinct units with Arrow, and looks each of them up once.
"""

from __future__ import annotations

import base64
import json
import os
import re
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Unicode White_Space, as the library's pattern has it.
SPACE = "\t-\r \x85\xa0  -     　"
#: Space characters other than the two that most texts have.
_RARE = [c for c in map(chr, range(0x3001)) if re.match(f"[{SPACE}]", c) and c not in " \n"]
_TWO_SPACES = re.compile(f"[{SPACE}]{{2}}").search


def _runs(text: str) -> bool:
    """Whether space characters stand side by side, so that units aren't just what single spaces and line feeds part."""
    if any(x in text for x in ("  ", " \n", "\n ", "\n\n")):
        return True
    return any(c in text for c in _RARE) and _TWO_SPACES(text) is not None


_UNITS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]").findall
#: Letters in every Unicode version, and units made of them and of ASCII, which need not pass through the library's splitter.
_LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_WORD = re.compile(f"[{_LETTER}]+").fullmatch
_PLAIN = re.compile(f"[\\x00-\\x7f{_LETTER}]*").fullmatch
_PIECES = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\\t-\\r {_LETTER}0-9]+|[\\t-\\r ]+(?![^\\t-\\r ])|[\\t-\\r ]+"
).findall
#: Units that one worker remembers newly; then they become the old ones, and those before are forgotten.
#: Longer units than REMEMBERED characters are not remembered, so that the memory has a bound in bytes.
CACHE, REMEMBERED = 200_000, 64
#: Characters of texts that are encoded together, or those of one longer text.
TOGETHER = 1 << 21
#: Marks that are a piece of their own behind a letter or a digit, up to the next space (an apostrophe may begin a piece).
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
_ENDS_WORD = f"[0-9{_LETTER}]$"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


def from_json(path: str):
    """The library's tokenizer from its own file."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def from_ranks(path: str, pattern: str):
    """A tokenizer of the library with the merges that a rank file implies.

    Rank files merge any adjacent pair whose bytes are a token, so every split of a
    token into two tokens is a merge, in the order of the tokens' ranks; a piece that
    is a token as it stands stays whole.
    """
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, chars = read_ranks(path), byte_chars()
    shown = {t: "".join(chars[b] for b in t) for t in ranks}
    merges = [
        (shown[t[:i]], shown[t[i:]])
        for t in sorted(ranks, key=ranks.get)
        for i in range(1, len(t))
        if t[:i] in ranks and t[i:] in ranks
    ]
    tok = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    tok.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    return tok


class Missing(dict):
    """A bounded dictionary that computes what it lacks; what is in use outlives an overflow."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(key) <= REMEMBERED:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[key] = out
        return out


class Spaced(Missing):
    """Identifiers of what stands behind a space; plain words, which are most, without a further call."""

    def __init__(self, make, tokenize, code: str):
        super().__init__(make)
        self.tokenize, self.code = tokenize, code

    def __missing__(self, part):
        if not (part.isascii() and part.isalpha()):
            return super().__missing__(part)
        out = self.old.get(part)
        if out is None:
            # the byte table's character for a space; letters stand for themselves
            out = array(self.code, [t.id for t in self.tokenize("\u0120" + part)]).tobytes()
        if len(part) <= REMEMBERED:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[part] = out
        return out


#: The pattern that units and pieces are made for; it is the one that ByteLevel has built in.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def splits_as_assumed(tokenizer) -> bool:
    """Whether a tokenizer takes texts as they are, parts them by PATTERN alone and merges bytes."""
    about = json.loads(tokenizer.to_str())
    found = about["pre_tokenizer"] or {}
    steps = found.get("pretokenizers", [found])
    built_in = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    split = {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Isolated", "invert": False}
    has = lambda step, want: all(step.get(k) == v for k, v in want.items())
    if len(steps) == 1:
        parted = has(steps[0], built_in)
    else:
        parted = len(steps) == 2 and has(steps[0], split) and has(steps[1], built_in | {"use_regex": False})
    plain = not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in about["added_tokens"] if not t["special"])
    merges = about["model"].get("type") == "BPE" and not about["model"].get("dropout")
    return parted and plain and merges and about["normalizer"] is None and about["truncation"] is None and about["padding"] is None


def _spans(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places ``start, start + 1, ...`` of all spans, one span after another."""
    ends = np.cumsum(lens)
    return np.repeat(starts - ends + lens, lens) + np.arange(ends[-1] if len(ends) else 0)


def _strings(coded: pa.DictionaryArray) -> list[str]:
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist()


def _without_marks(words: pa.LargeStringArray) -> tuple[pa.LargeStringArray, pa.LargeStringArray]:
    """Each word up to the marks behind its last letter or digit, and those marks; other words whole."""
    bare = pc.utf8_rtrim(words, characters=_MARKS)
    bare = pc.if_else(pc.match_substring_regex(bare, _ENDS_WORD), bare, words)
    kept, size = (pc.binary_length(x).to_numpy() for x in (bare, words))
    _, offsets, data = words.buffers()
    starts = np.frombuffer(offsets, "<i8", len(words), 8 * words.offset)
    marks = np.frombuffer(data, np.uint8)[_spans(starts + kept, size - kept)] if (size > kept).any() else np.zeros(0, np.uint8)
    ends = np.concatenate([[0], np.cumsum(size - kept)]).astype("<i8")
    return bare, pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(ends), pa.py_buffer(marks))


class Encoder:
    """Texts to identifiers, as ``tokenizer.encode(text, add_special_tokens=False)`` gives them.

    Units are remembered where the tokenizer parts texts by PATTERN and has no normalizer;
    another tokenizer's texts go through the library whole.
    """

    def __init__(self, tokenizer):
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.by_units = splits_as_assumed(tokenizer)
        self.dtype = np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.code = {2: "H", 4: "I"}[self.dtype.itemsize]
        self.table = str.maketrans({b: c for b, c in enumerate(byte_chars())})
        if sys.byteorder == "big":
            raise RuntimeError("identifiers are kept as this machine has them, and files are little-endian")
        self.pieces = Missing(self._piece)
        self.whole = Missing(self._unit)
        self.spaced = Spaced(self._after_space, self.model.tokenize, self.code)
        self.marks = {m: self._merge(m) for m in ".,"}
        self.line = self._merge(byte_chars()[10])

    def forget(self) -> None:
        """Drop all units that are remembered."""
        for units in (self.pieces, self.whole, self.spaced):
            units.clear()
            units.old = {}

    def _bytes(self, ids: Iterable[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _merge(self, mapped: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.table))]).tobytes()

    def _after_space(self, part: str) -> bytes:
        if part[-1:] in self.marks and part[:-1].isalpha():
            return self.spaced[part[:-1]] + self.marks[part[-1]]
        if part[:1] == "\n":
            return self.line + (self.whole[part[1:]] if part[1:] else b"")
        return self._unit(" " + part)

    def _unit(self, unit: str) -> bytes:
        if _WORD(unit, 1 if unit[:1] == " " else 0):
            return self._piece(unit)
        if _PLAIN(unit):
            return b"".join(map(self.pieces.__getitem__, _PIECES(unit)))
        return b"".join(self._merge(p) for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(unit))

    def encode(self, text: str) -> bytes:
        """A text's identifiers as bytes of ``dtype``."""
        if not self.by_units or any(s in text for s in self.special):
            return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if _runs(text):
            return b"".join(map(self.whole.__getitem__, _UNITS(text)))
        first, *rest = text.replace("\n", " \n").split(" ")  # a lone line feed is a piece of its own
        return (self.whole[first] if first else b"") + b"".join(map(self.spaced.__getitem__, rest))

    def encode_rows(self, rows: Iterable[tuple]) -> Iterator[tuple]:
        """Pairs of anything and a text, as pairs of the same and the text's identifiers, TOGETHER characters at a time."""
        keys: list = []
        texts: list[str] = []
        size = 0
        for key, text in rows:
            keys.append(key)
            texts.append(text)
            size += len(text)
            if size >= TOGETHER:
                yield from zip(keys, self.encode_all(texts))
                keys, texts, size = [], [], 0
        yield from zip(keys, self.encode_all(texts))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """What ``encode`` gives for each text; distinct words are looked up once."""
        out: list[bytes | None] = [None] * len(texts)
        firsts, rests = [], []
        for k, text in enumerate(texts):
            if not self.by_units or any(s in text for s in self.special) or _runs(text):
                out[k] = self.encode(text)
            else:
                first, space, rest = text.replace("\n", " \n").partition(" ")
                firsts.append((k, first))
                rests.append(rest if space else None)
        parts = pc.split_pattern(pa.array(rests, pa.large_string()), " ")
        n_parts = pc.fill_null(pc.list_value_length(parts), 0).to_numpy()
        coded, ends = self._spaced_parts(pc.list_flatten(parts))
        ends, begin = ends[np.cumsum(n_parts)].tolist(), 0
        for (k, first), end in zip(firsts, ends):
            out[k] = (self.whole[first] if first else b"") + coded[begin:end]
            begin = end
        return out

    def _spaced_parts(self, parts: pa.LargeStringArray) -> tuple[bytes, np.ndarray]:
        """Identifiers of what stands behind a space each, in one run, and where each part begins in it; the run's end is the last."""
        found = parts.dictionary_encode()
        bare, marks = (x.dictionary_encode() for x in _without_marks(found.dictionary))
        known = [self.spaced[w] for w in _strings(bare)] + [self.pieces[m] if m else b"" for m in _strings(marks)]
        at = np.cumsum([0, *map(len, known)]) // self.dtype.itemsize
        ids = np.frombuffer(b"".join(known), self.dtype)
        # a distinct part is a bare word and its marks, a part is one of the distinct parts
        pairs = np.stack([bare.indices.to_numpy(), marks.indices.to_numpy() + len(bare.dictionary)], 1).reshape(-1)
        lens = np.diff(at)[pairs]
        ids = ids[_spans(at[pairs], lens)]
        lens = lens.reshape(-1, 2).sum(1)
        own = found.indices.to_numpy()
        ids = ids[_spans((np.cumsum(lens) - lens)[own], lens[own])]
        return ids.tobytes(), np.concatenate([[0], np.cumsum(lens[own])]) * self.dtype.itemsize


_held: dict[tuple, object] = {}


def encoder(path: str, pattern: str | None = None) -> Encoder:
    """This worker's encoder for a file: a library file, or a rank file with its pattern."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, pattern) not in _held:
        _held[path, pattern] = Encoder(from_ranks(path, pattern) if pattern else from_json(path))
    return _held[path, pattern]
