"""Public tokenizer files: where they lie, and splitting texts the way the byte-level vocabularies split them."""

from __future__ import annotations

import functools
import re

#: Letters, numbers and white space below U+0180, where a plain character class says the same as \\p{L}, \\p{N} and \\s.
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACE = "\t-\r \x85\xa0"
_OTHER = re.compile("[^\x00-ſ‐-‧]")
_NEAR = re.compile(f" ?[{_LETTER}]+|'(?:[stmd]|re|ve|ll)| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(1)
def _wide():
    from tokenizers.pre_tokenizers import ByteLevel

    return ByteLevel(add_prefix_space=False).pre_tokenize_str


def split_text(text: str) -> list[str]:
    """The pre-tokens of the byte-level vocabularies. Texts of Latin letters take a pattern that a faster engine runs, others the library's own splitter."""
    return [text[a:b] for _, (a, b) in _wide()(text)] if _OTHER.search(text) else _NEAR.findall(text)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabulary files: printable Latin-1 for itself, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]
