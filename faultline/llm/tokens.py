"""Token ids of whole texts with a public byte-level BPE vocabulary.

The pattern of the vocabulary never joins a word with what follows its space, so a text
whose spaces are single ones is encoded unit by unit (a unit: a space and what stands up to
the next), each distinct unit once per worker and cache. Any other text (runs of spaces,
other space characters) is encoded whole. Both ways give the ids of the whole text.
"""

from __future__ import annotations

import re
from array import array
from functools import cache

import numpy as np

#: Units kept per worker; the cache is emptied beyond that, so its memory is bounded.
CACHE_UNITS = 700_000
#: What Unicode counts as space besides the space itself, as UTF-8; and their first bytes apart from the line end's.
_SPACE = b"(?:[ \t\n\x0b\x0c\r\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)"
_BESIDE = re.compile(b" " + _SPACE + b"|" + _SPACE + b" |^ | $")
_RARE = b"\t\x0b\x0c\r\x1c\x1d\x1e\x1f\xe1\xe2\xe3"


def _odd(text: bytes) -> bool:
    """Whether a space stands beside another or at an end; then the text can't be cut at spaces."""
    if b"  " in text or b" \n" in text or b"\n " in text or text[:1] == b" " or text[-1:] == b" ":
        return True
    rare = len(text.translate(None, _RARE)) < len(text) or not text.isascii() and (b"\xc2\xa0" in text or b"\xc2\x85" in text)
    return rare and _BESIDE.search(text) is not None


@cache
def _tokenizer(file: str):
    from tokenizers import Tokenizer
    from public_tokenizers import path

    return Tokenizer.from_file(path(file))


@cache
def special_tokens(file: str) -> re.Pattern | None:
    """A pattern of the vocabulary's special tokens, which are one id wherever they stand; None where there are none."""
    import json

    from public_tokenizers import path

    with open(path(file), encoding="utf-8") as f:
        found = [t["content"] for t in json.load(f).get("added_tokens", [])]
    return re.compile("|".join(map(re.escape, sorted(found, key=len, reverse=True)))) if found else None


@cache
def _special(file: str) -> re.Pattern | None:
    found = special_tokens(file)
    return found and re.compile(found.pattern.encode())


@cache
def _fast(file: str):
    """The same vocabulary as ranks, for single units; None where there is no such file."""
    import base64

    import public_tokenizers
    import tiktoken

    try:
        with open(public_tokenizers.path(file.replace(".json", ".tiktoken")), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    except (OSError, KeyError, ValueError):
        return None
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """bytes of a text -> its ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, file: str):
        self.file = file
        assert array("I").itemsize == 4
        self.units: dict[bytes, bytes] = {}

    def whole(self, text: bytes) -> bytes:
        ids = _tokenizer(self.file).encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _unit(self, text: bytes) -> bytes:
        fast = _fast(self.file)
        if fast is None:
            return self.whole(text)
        return array("I", fast.encode_ordinary(text.decode("utf-8", "replace"))).tobytes()

    def encode(self, text: bytes) -> bytes:
        if not text:
            return b""
        special = _special(self.file)
        if special is not None and special.search(text) or _odd(text):
            return self.whole(text)
        head, *rest = text.split(b" ")
        units = self.units
        if len(units) > CACHE_UNITS:
            units.clear()
        get = units.get
        found = [get(u) for u in rest]
        try:
            tail = b"".join(found)
        except TypeError:
            for i, x in enumerate(found):
                if x is None:
                    found[i] = x = get(rest[i]) or self._unit(b" " + rest[i])
                    units[rest[i]] = x
            tail = b"".join(found)
        return self._unit(head) + tail
