"""Token ids from the tokenizers library, by the piece.

Both vocabularies split a text before merging, and never merge across a change from
non-space to space.  So the ids of a text are those of its space-led pieces, one after
another; each distinct piece is encoded by the library once and kept, as little-endian
unsigned 32-bit ids, in a table of bounded size.
"""

from __future__ import annotations

import os
import re
import string
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MOST_PIECES = 600_000
_ODD = re.compile("[\x1c-\x1f]")  # white space to Python, not to the library
#: White space beyond tab, line feed, form feed, carriage return and space: such texts are cut with care.
_STRANGE = "[\x0b\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_SPACE = r"[\t\n\f\r ]"
_PIECES = re.compile(r"\s*\S+|\s+")
_MARKS = string.punctuation
_PACK = [struct.Struct(f"<{n}I").pack for n in range(24)]


def _byte_alphabet() -> str:
    """The vocabularies' letters for bytes 0 to 255: printable Latin-1 bytes are themselves, the others count up from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return "".join(chr(b) if b in printable else chr(0x100 + others.index(b)) for b in range(256))


_ALPHABET = _byte_alphabet()


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Table(dict):
    """Ids of pieces, all with the same lead; a piece that is missing is encoded when it is asked for.

    A word of Latin letters is one unit to either vocabulary, so its merges alone are run, on the byte
    alphabet; a word, the marks after it and a lone line break between two pieces are apart; a vocabulary
    that lower-cases sees both cases alike.  Anything else goes through the whole tokenizer."""

    def __init__(self, tokenizer, lead: str, lower: bool, plain: _Table | None = None):
        self.tokenizer, self.merge, self.lead, self.lower = tokenizer, tokenizer.model.tokenize, lead, lower
        self.glyph, self.most = lead.translate(_ALPHABET), "ÿ" if lower else "ɏ"
        self.plain = self if plain is None else plain
        self.old: dict[str, bytes] = {}

    def age(self) -> None:
        """What is held becomes the old half, and the old half goes: pieces that are asked for again come back."""
        self.old = dict(self)
        self.clear()

    def __missing__(self, p: str) -> bytes:
        if (ids := self.old.get(p)) is not None:
            self[p] = ids
            return ids
        head = p.rstrip(_MARKS)
        if head.isalpha() and (head.isascii() or max(head) <= self.most):
            if self.lower:
                head = head.lower()
            if len(head) < len(p):
                ids = self[head] + self.plain[p[len(head) :]]
            elif head != p:
                ids = self[head]
            else:
                found = [t.id for t in self.merge(self.glyph + (p if p.isascii() else p.encode().decode("latin-1").translate(_ALPHABET)))]
                ids = _PACK[len(found)](*found) if len(found) < len(_PACK) else pack(found)
        elif "\n" in p and (parts := p.split("\n")) == p.split():
            ids = self[parts[0]] + b"".join(self.plain["\n"] + self.plain[x] for x in parts[1:])
        else:
            ids = pack(self.tokenizer.encode(self.lead + p, add_special_tokens=False).ids)
        self[p] = ids
        return ids


class TokenCache:
    """encode_all(column) gives each text's ids as bytes.  spaces: whether the vocabulary keeps white space."""

    def __init__(self, path: str, spaces: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.spaces = spaces
        self.plain = _Table(self.tokenizer, "", not spaces)
        self.led = _Table(self.tokenizer, " ", not spaces, self.plain)

    def encode(self, text: str) -> bytes:
        """One text, whatever its white space."""
        if _ODD.search(text):
            return pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        plain = self.plain.__getitem__
        return b"".join(map(plain, _PIECES.findall(text) if self.spaces else text.split()))

    def encode_all(self, column: pa.Array) -> list[bytes]:
        """Null is empty.  Pieces are cut, and told apart, by Arrow; each distinct one is looked up once."""
        column = pc.fill_null(column.cast(pa.string()), "")
        if len(self.plain) + len(self.led) > MOST_PIECES // 2:
            self.plain.age()
            self.led.age()
        strange = pc.match_substring_regex(column, _STRANGE if not self.spaces else f"{_STRANGE}| {_SPACE}|{_SPACE} ").to_numpy(zero_copy_only=False)
        plain = column.filter(pa.array(~strange)) if strange.any() else column
        parts = pc.split_pattern(plain, " ") if self.spaces else pc.ascii_split_whitespace(pc.ascii_lower(plain))
        coded = parts.flatten().dictionary_encode()
        codes, offsets = coded.indices.to_numpy().astype(np.int64), parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()
        table = self.led if self.spaces else self.plain
        ids = list(map(table.__getitem__, coded.dictionary.to_pylist()))
        if self.spaces:  # a text's first piece has no space before it
            firsts = offsets[:-1]
            dictionary = coded.dictionary
            heads = [dictionary[int(c)].as_py() for c in codes[firsts]]
            codes = codes.copy()
            codes[firsts] = np.arange(len(ids), len(ids) + len(heads))
            ids += map(self.plain.__getitem__, heads)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        blob, at = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
        many = size[codes]
        ends = np.cumsum(many)
        out = blob[np.repeat(at[codes] - (ends - many), many) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
        cut = (4 * np.r_[0, ends][offsets]).tolist()
        done = [out[a:b] for a, b in zip(cut, cut[1:])]
        if strange.any():
            rest = iter(done)
            texts = column.to_pylist()
            done = [self.encode(texts[i]) if odd else next(rest) for i, odd in enumerate(strange.tolist())]
        return done


_caches: dict[tuple[str, bool], TokenCache] = {}


def cached(path: str, spaces: bool) -> Callable[[pa.Array], list[bytes]]:
    """The worker's table for a vocabulary file; kept from task to task."""
    if (path, spaces) not in _caches:
        _caches[path, spaces] = TokenCache(path, spaces)
    return _caches[path, spaces].encode_all


_special: dict[str, Callable[[str], bytes]] = {}


def _whole(path: str) -> Callable[[str], bytes]:
    """The library as it comes, on whole texts; loaded when a text needs it."""
    if path not in _special:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        _special[path] = lambda text: pack(tokenizer.encode(text, add_special_tokens=False).ids)
    return _special[path]


def library_ids(path: str, spaces: bool) -> Callable[[pa.Array], list[bytes]]:
    """As cached, but as the library has it by default: an added token's string in a text is that token.

    Such texts go whole through the library; their number does not matter to the others."""
    encode = cached(path, spaces)
    added = re.compile("|".join(re.escape(t.content) for t in _caches[path, spaces].tokenizer.get_added_tokens_decoder().values()))

    def ids(column: pa.Array) -> list[bytes]:
        column = pc.fill_null(column.cast(pa.string()), "")
        marked = pc.match_substring_regex(column, added.pattern) if added.pattern else pa.array([False] * len(column))
        if not pc.any(marked).as_py():
            return encode(column)
        done = encode(pc.if_else(marked, "", column))
        whole = _whole(path)
        for i in np.flatnonzero(marked.to_numpy(zero_copy_only=False)).tolist():
            done[i] = whole(column[i].as_py())
        return done

    return ids
