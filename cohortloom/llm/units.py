"""Token ids of whole texts, with the tokenizers library called once per distinct unit.

A unit is a stretch of text that the tokenizer's own pre-tokenizer never joins with its
neighbours, so the ids of a text are the ids of its units one after the other. For a
tokenizer that drops white space a unit is a word between ASCII blanks; for a byte-level
one it is a word with the space before it, or a run of blanks. A unit that ends in
punctuation is looked up as word and punctuation, which such tokenizers also part. Texts
with blanks for which this does not hold (control separators, non-ASCII spaces), and texts
that hold an added token of the tokenizer, are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct units a worker remembers in each of its two generations.
REMEMBERED = 500_000
#: Text bytes to encode in one call: larger calls meet a unit more often, and hold about 20 times that.
ENCODE_BYTES = 5_000_000
#: New units that one call of the library encodes.
TOGETHER = 400
_BLANK = rb" \t\n\r\x0b\x0c"
_UNITS = re.compile(rb" ?[^" + _BLANK + rb"]+|[" + _BLANK + rb"]+(?![^" + _BLANK + rb"])|[" + _BLANK + rb"]+")
_WIDE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_ODD = re.compile(rb"[\x00\x1c-\x1f]")
#: Other blanks than single spaces and line ends between words: such texts split by a pattern.
_UNEVEN = r"[ \n][ \n]|[\x00-\x09\x0b-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Words of Latin letters, and those that lowering and composing leave as they are.
_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf])+")
_SMALL_WORD = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
_SAMPLES = ["straße".encode(), "été".encode(), b"a", b"internationalization", "ñandú".encode(), b"zzqx"]
#: How byte-level models spell bytes: printable ones as themselves, the others from U+0100 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_SIGNS = {b: chr(0x100 + n) for n, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}
_TAIL = b".,;:!?%&*#$|)\""
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])


class Encoder:
    """One tokenizer file, ready in a worker."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.style = _style(spec)
        #: strings that the tokenizer cuts out before anything else; texts with them are encoded whole
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.kind = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        self.memo: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.between = b" \x01 " if self.style == "words" else b"\n"
        mark = self.tokenizer.encode(self.between.decode(), add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        # a word of letters is one piece to the pre-tokenizer, so the model may be asked for it alone
        self.single = self.style is not None and all(self._model(w) == self._plain(w) for w in _SAMPLES)

    def _model(self, unit: bytes) -> bytes:
        ids = [t.id for t in self.tokenizer.model.tokenize(unit.decode("latin-1").translate(_BYTE_SIGNS))]
        return np.asarray(ids, dtype=self.kind).tobytes()

    def _plain(self, data: bytes) -> bytes:
        ids = self.tokenizer.encode(data.decode("utf-8"), add_special_tokens=False).ids
        return np.asarray(ids, dtype=self.kind).tobytes()

    def encode(self, texts: pa.Array, end_id: int | None = None) -> pa.Array:
        """The ids of every text as one binary value of ``kind``, with the end id after them.

        The texts are split and their distinct units found by Arrow; Python sees each
        distinct unit of the call once, and the ids are laid out by one gather. Null and
        empty texts have no ids of their own. Rows that need another way of splitting, or
        none, take it for themselves.
        """
        end = b"" if end_id is None else np.array([end_id], dtype=self.kind).tobytes()
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not len(texts):
            return pa.array([], pa.binary())
        whole = self._whole(texts)
        odd = pc.and_not(pc.match_substring_regex(texts, _UNEVEN), whole) if self.style == "bytes" else None
        groups = []
        for rows, way in ((whole, "whole"), (odd, "odd")):
            picked = [] if rows is None or not pc.any(rows).as_py() else np.flatnonzero(rows).tolist()
            if picked:
                groups.append((picked, self._one_by_one(texts.take(pa.array(picked)), way, end)))
        if not groups:
            return self._gathered(*self._units(texts), end)
        rest = np.ones(len(texts), dtype=bool)
        for picked, _ in groups:
            rest[picked] = False
        left = np.flatnonzero(rest)
        if len(left):
            groups.append((left.tolist(), self._gathered(*self._units(texts.take(pa.array(left))), end)))
        back = np.argsort(np.concatenate([np.asarray(rows) for rows, _ in groups]))
        return pa.concat_arrays([ids for _, ids in groups]).take(pa.array(back))

    def _whole(self, texts: pa.Array) -> pa.Array:
        """Rows that must be encoded whole: all of an unknown style, and those with an added token."""
        found = pa.array(np.full(len(texts), self.style is None))
        common = os.path.commonprefix(self.added)
        if self.style is None or not self.added or (
                common and not any(map(str.isalpha, common)) and
                not pc.any(pc.match_substring(texts, common)).as_py()):
            return found
        for content in self.added:
            found = pc.or_(found, pc.match_substring(texts, content, ignore_case=True))
        return found

    def _one_by_one(self, texts: pa.Array, way: str, end: bytes) -> pa.Array:
        out = []
        for text in texts.cast(pa.binary()).to_pylist():
            units = _byte_units(text) if way == "odd" else None
            out.append((self._plain(text) if units is None else b"".join(self._known(units))) + end)
        return pa.array(out, pa.binary())

    def _units(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Units of all texts end to end, and where each text's units begin and end."""
        if self.style == "words":
            # ASCII letters only are lowered here, as the tokenizer's first steps do
            split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        else:
            split = _even_units(texts)
        bounds = split.offsets.to_numpy().astype(np.int64)
        return split.flatten(), bounds - bounds[0]

    def _gathered(self, units: pa.Array, bounds: np.ndarray, end: bytes) -> pa.Array:
        coded = units.dictionary_encode()
        known = self._by_heads(coded.dictionary)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        if end:  # the end id is one more unit of each text
            codes = np.insert(codes, bounds[1:], len(known))
            bounds = bounds + np.arange(len(bounds))
        ids = pa.concat_arrays([known, pa.array([end], pa.binary())]).take(pa.array(codes))
        _, offsets, data = ids.buffers()
        reach = np.frombuffer(offsets, dtype=np.int32)[ids.offset + bounds] if len(ids) else np.zeros(len(bounds), np.int32)
        return pa.Array.from_buffers(pa.binary(), len(bounds) - 1,
                                     [None, pa.py_buffer(np.ascontiguousarray(reach)), data or pa.py_buffer(b"")])

    def _by_heads(self, units: pa.Array) -> pa.Array:
        """Ids of distinct units; a word and the marks after it are looked up apart."""
        heads = pc.ascii_rtrim(units, characters=_TAIL.decode())
        begins, raw = _layout(units)
        sizes, kept = np.diff(begins), np.diff(_layout(heads)[0])
        last = np.frombuffer(raw, np.uint8)[np.maximum(begins[:-1] + kept - 1, 0)] if raw else np.zeros(len(heads), np.uint8)
        parted = (sizes > kept) & (kept > 0) & ((last >= 128) | _LETTER[last])
        for i in np.flatnonzero(parted & (last >= 128)).tolist():
            parted[i] = _ends_in_letter(raw[begins[i]:begins[i] + kept[i]])
        coded = pc.if_else(pa.array(parted), heads, units).dictionary_encode()
        known = pa.array(self._known(_pieces(coded.dictionary.cast(pa.binary()))), pa.binary()).take(coded.indices)
        at = np.flatnonzero(parted)
        tails = [raw[i:j] for i, j in zip((begins[at] + kept[at]).tolist(), begins[at + 1].tolist())]
        marks = {tail: k for k, tail in enumerate(dict.fromkeys(tails), 1)}
        code = np.zeros(len(units), dtype=np.int32)
        code[at] = [marks[tail] for tail in tails]
        behind = pa.array([b"", *self._known(list(marks))], pa.binary()).take(pa.array(code))
        return pc.binary_join_element_wise(known, behind, b"")

    def _known(self, units: list[bytes]) -> list[bytes]:
        """Ids of each unit, from memory or learned now."""
        known = list(map(self.memo.get, units))
        missing = [i for i, ids in enumerate(known) if ids is None]
        if missing:
            self._learn({units[i] for i in missing})
            memo = self.memo
            for i in missing:
                known[i] = memo[units[i]]
            if len(memo) > REMEMBERED:
                self.old, self.memo = memo, {}
        return known

    def _learn(self, new: set[bytes]) -> None:
        memo, old = self.memo, self.old
        for unit in old.keys() & new:
            memo[unit] = old[unit]
        self._encode(list(new.difference(old)))

    def _encode(self, units: list[bytes]) -> None:
        """Ids of new units, many to a call with a mark between them that is one id."""
        memo, size, mark = self.memo, self.kind.itemsize, self.between.strip(b" ")
        if self.single:
            tokenize, form = self.tokenizer.model.tokenize, "<%dH" if size == 2 else "<%dI"
            fits = _WORD.fullmatch if self.style == "bytes" else _SMALL_WORD.fullmatch
            space, rest = _BYTE_SIGNS[0x20], []
            for unit in units:
                if unit.isalpha():  # of bytes: ASCII letters only
                    text = unit.decode()
                elif unit[:1] == b" " and unit[1:].isalpha():
                    text = space + unit[1:].decode()
                elif fits(unit):
                    text = unit.decode("latin-1").translate(_BYTE_SIGNS)
                else:
                    rest.append(unit)
                    continue
                ids = [t.id for t in tokenize(text)]
                memo[unit] = struct.pack(form % len(ids), *ids)
            units = rest
        alone = [u for u in units if not u or u.isspace()] if self.mark is not None else units
        if alone:
            for unit in alone:
                memo[unit] = self._plain(unit)
            units = [u for u in units if u not in memo]
        for at in range(0, len(units), TOGETHER):
            part = units[at:at + TOGETHER]
            joined = self.between.join(part)
            ids = np.asarray(self.tokenizer.encode(joined.decode("utf-8"), add_special_tokens=False).ids,
                             dtype=self.kind) if joined.count(mark) == len(part) - 1 else np.zeros(0, self.kind)
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) != len(part) - 1 or not len(ids):  # a unit holds the mark or made its id
                for unit in part:
                    memo[unit] = self._plain(unit)
                continue
            data = ids.tobytes()
            ends = [*(cuts * size).tolist(), len(data)]
            memo.update(zip(part, [data[a:b] for a, b in zip([0, *[e + size for e in ends]], ends)]))


def _ends_in_letter(core: bytes) -> bool:
    """Is the last character, a non-ASCII one, a letter also once composed and lowered?"""
    return unicodedata.normalize("NFC", core.decode("utf-8")[-1]).lower()[-1].isalpha()


def _even_units(texts: pa.Array) -> pa.Array:
    marked = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0")
    return pc.split_pattern(marked, "\0")


def _layout(column: pa.Array) -> tuple[np.ndarray, bytes]:
    """Where each value of a string column begins and the last one ends, and its bytes."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[column.offset:column.offset + len(column) + 1]
    return at, memoryview(data).tobytes() if data else b""


def _pieces(column: pa.Array) -> list[bytes]:
    """A binary column as bytes objects, cut from its buffer."""
    begins, raw = _layout(column)
    at = begins.tolist()
    return [raw[a:b] for a, b in zip(at, at[1:])]


def _byte_units(text: bytes) -> list[bytes] | None:
    """Units of one text with blanks of any kind; None: the text must be encoded whole."""
    if (not text.isascii() and _WIDE.search(text)) or _ODD.search(text):
        return None
    return _UNITS.findall(text)


def _style(spec: dict) -> str | None:
    """How units split, read from the tokenizer file; None: always encode whole texts."""
    if spec.get("post_processor") not in (None,) and spec["post_processor"].get("type") != "ByteLevel":
        return None
    before, normalizer = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if before.get("type") == "ByteLevel" and normalizer is None:
        return "bytes" if before.get("use_regex") and not before.get("add_prefix_space") else None
    parts = before.get("pretokenizers", [])
    if parts and parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" \
            and parts[0].get("invert") and "\\s" in parts[0]["pattern"].get("Regex", ""):
        return "words"
    return None


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)
