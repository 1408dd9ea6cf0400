"""Cutting texts into the pre-tokens of the two public BPE vocabularies.

The classes are those of Unicode: letters (L), numbers (N: Nd, Nl, No), white space and the
rest. Python's ``\\w`` counts Nl and No with letters and its ``\\s`` adds four control
characters, so both are spelled out here. Python and the tokenizers library hold tables of different
Unicode versions; a text with a character these may treat differently is cut by the library's own steps.
"""

from __future__ import annotations

import re
import sys
import unicodedata

#: Unicode white space, contractions of the pre-tokenizers.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


def _ranges(points: list[int]) -> str:
    out, start = [], None
    for i, p in enumerate(points):
        start = p if start is None else start
        if i + 1 == len(points) or points[i + 1] != p + 1:
            out.append(chr(start) if start == p else f"{chr(start)}-{chr(p)}")
            start = None
    return "".join(out)


#: Outside these characters the letters are those of LATIN, the numbers 0-9 and white space is
#: Python's, so a cheaper pattern cuts the text alike.
RARE = re.compile("[\x1c-\x1f²³¹¼½¾ƀ-\U0010ffff]")
LATIN = "a-zA-ZªµºÀ-ÖØ-öø-ſ"
#: Below these characters all versions agree.
BEYOND = re.compile("[\u0370-\U0010ffff]")


def unsettled(char: str) -> bool:
    """Whether Unicode versions may differ in the character's class, case or place in NFC."""
    return (
        unicodedata.category(char) == "Cn"
        or unicodedata.combining(char) > 0
        or (char > "\uffff" and unicodedata.decomposition(char)[:1] not in ("", "<"))
    )


def classes() -> tuple[str, str, str]:
    """Regular expressions for one letter, one number, one other character."""
    odd = _ranges([p for p in range(sys.maxunicode + 1) if unicodedata.category(chr(p)) in ("No", "Nl")])
    return rf"[^\W\d_{odd}]", rf"[\d{odd}]", rf"(?:[^\w{WHITE}{odd}]|_)"


def byte_patterns() -> tuple[re.Pattern, re.Pattern]:
    """Pre-tokens that keep one leading blank: for any text, and for one without RARE.

    The alternatives start with different characters but for blanks, so letters come first.
    """
    letter, number, other = classes()
    return (
        re.compile(rf" ?{letter}+|{CONTRACTIONS}| ?{number}+| ?{other}+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"),
        re.compile(rf" ?[{LATIN}]+|{CONTRACTIONS}| ?[0-9]+| ?[^{LATIN}0-9\s]+|\s+(?!\S)|\s+"),
    )


def word_patterns() -> tuple[re.Pattern, re.Pattern]:
    """Pre-tokens of the lower-casing vocabulary, which drops white space; as above."""
    letter, number, other = classes()
    return (
        re.compile(rf"{letter}+|{CONTRACTIONS}|{number}|{other}+"),
        re.compile(rf"[{LATIN}]+|{CONTRACTIONS}|[0-9]|[^{LATIN}0-9\s]+"),
    )


class Cutter:
    """Cuts texts into pre-tokens of a tokenizer file's text, and out the strings of added tokens before that.

    ``chunks`` yields (added token or None, list of pre-tokens).
    """

    def __init__(self, lower: bool, added: dict[str, int], tokenizer_json: str) -> None:
        self.lower, self.added, self.spec, self.library = lower, added, tokenizer_json, None
        self.any, self.plain = word_patterns() if lower else byte_patterns()
        longest = sorted(added, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, longest))) if added else None

    def words(self, text: str) -> list[str]:
        own = lowered(text) if self.lower else text
        if not RARE.search(own):
            return self.plain.findall(own)
        # Looked for after NFC, which may have made a composite the library does not know.
        return self.library_words(text) if any(map(unsettled, set(BEYOND.findall(own)))) else self.any.findall(own)

    def library_words(self, text: str) -> list[str]:
        """The same by the library's normaliser and pre-tokenizer."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.spec)
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        return [text[start:end] for _, (start, end) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def chunks(self, text: str):
        at = 0
        if self.special is not None:
            for m in self.special.finditer(text):
                yield None, self.words(text[at : m.start()])
                yield self.added[m[0]], []
                at = m.end()
        yield None, self.words(text[at:] if at else text)


def lowered(text: str) -> str:
    """NFC, then each character lower-cased by itself (no final sigma)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    symbols = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [symbols[b] for b in range(256)]
