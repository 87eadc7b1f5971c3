"""Token ids by a public tokenizer file, with words that repeat looked up instead of encoded again.

``encoder(path)`` gives a function from texts to little-endian unsigned 32-bit ids, equal to the library's own
``encode(text, add_special_tokens=False)``. A text made only of Latin letters below U+0180, ASCII signs and plain white
space is split here into the same words as the file's own splitting rule and each distinct word is encoded once;
every other text goes to the library whole.
"""

from __future__ import annotations

from collections.abc import Callable

# Words remembered by one worker; when full, the memory starts anew.
REMEMBERED = 250_000


def public_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The printable stand-in for each byte that byte-level vocabularies use."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = (b for b in range(256) if b not in set(kept))
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(moved)}


def encoder(path: str, remembered: int = REMEMBERED) -> Callable[[str], bytes]:
    import json
    import os
    import re
    import struct
    import unicodedata

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def whole(text: str) -> bytes:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    rules = [s.get("pattern", {}).get("Regex") for s in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    known = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    normal = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    special = [t["content"] for t in spec.get("added_tokens", [])]
    if known not in rules or normal != ["NFC", "Replace", "Lowercase"]:
        return whole

    latin = [chr(c) for c in range(0xA1, 0x180)]
    letters = "a-z" + "".join(c for c in latin if unicodedata.category(c).startswith("L"))
    digits = "0-9" + "".join(c for c in latin if unicodedata.category(c).startswith("N"))
    # Without the soft hyphen and the dotted capital I, whose lower case is two characters.
    plain = re.compile("[\t-\r -~\u00a1-\u00ac\u00ae-\u012f\u0131-\u017f]*")
    words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^\s{letters}{digits}]+").findall
    stand_in = str.maketrans(byte_letters())
    tokenize = tokenizer.model.tokenize

    def one_word(word: str) -> bytes:
        ids = [t.id for t in tokenize(word.encode().decode("latin-1").translate(stand_in))]
        return struct.pack(f"<{len(ids)}I", *ids)

    class Memory(dict):
        def __init__(self, make: Callable[[str], bytes]):
            self.make = make

        def __missing__(self, key: str) -> bytes:
            if len(self) >= remembered:
                self.clear()
            out = self[key] = self.make(key)
            return out

    look = Memory(one_word).__getitem__
    # No word spans white space, so the runs between it are remembered too.
    look_run = Memory(lambda run: b"".join(map(look, words(run)))).__getitem__

    def encode(text: str) -> bytes:
        if plain.fullmatch(text) is None or any(s in text for s in special):
            return whole(text)
        return b"".join(map(look_run, text.lower().split()))

    return encode
