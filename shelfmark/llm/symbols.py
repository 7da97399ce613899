"""Fixed alphabets of 32 and of 64 symbols that any text can be read in.

They bound what models over characters can grow to: there are at most 32**n or
64**n n-grams, whatever the corpus.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

SYMBOLS = 32
#: 0 stands before and after a text; 1 to 26 are letters without case and accent,
#: those of other scripts than Latin by a hash.
EDGE, SPACE, DIGIT, PUNCTUATION, SIGN, OTHER = 0, 27, 28, 29, 30, 31


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """Symbol of each code point."""
    symbols = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x250):
        base = unicodedata.normalize("NFD", chr(code))[0].lower()
        if "a" <= base <= "z":
            symbols[code] = ord(base) - ord("a") + 1
        elif base.isspace():
            symbols[code] = SPACE
        elif "0" <= base <= "9":
            symbols[code] = DIGIT
        elif base in ".,;:!?'\"-()":
            symbols[code] = PUNCTUATION
        elif code < 128:
            symbols[code] = SIGN
    # Other scripts: letters fall into the 26 symbols of letters by hash, so that their n-grams tell.
    for code in range(0x250, 0x32400):
        char = chr(code)
        if char.isalpha():
            base = ord(unicodedata.normalize("NFD", char)[0].lower()[0]) if code < 0x2000 else code
            symbols[code] = 1 + (base * 0x9E3779B1 & 0xFFFFFFFF) % 26
        elif char.isspace():
            symbols[code] = SPACE
        elif char.isdigit():
            symbols[code] = DIGIT
        elif unicodedata.category(char)[0] == "P":
            symbols[code] = PUNCTUATION
    return symbols


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@lru_cache(maxsize=1)
def fine_table() -> np.ndarray:
    """Symbol of each code point in the alphabet of 64, which tells accents and stops apart.

    Beyond Latin-1 letters, digits and spaces are read as in symbol_table(), all else as 55.
    """
    symbols = np.full(0x110000, 55, np.uint8)
    for code in range(128):
        low = chr(code).lower()
        if "a" <= low <= "z":
            symbols[code] = ord(low) - ord("a") + 1
        else:
            symbols[code] = SPACE if low.isspace() else DIGIT if low.isdigit() else 29 if low == "." else 30 if low == "," else 31
    for code in range(0xC0, 0x100):
        if code not in (0xD7, 0xF7):
            symbols[code] = 32 + (code & 31)
    other = symbol_table()[0x100:]
    told = (other >= 1) & (other <= DIGIT)
    symbols[0x100:][told] = other[told]
    return symbols


def ngram_codes(symbols: np.ndarray, order: int, bits: int = 5) -> np.ndarray:
    """For each position the last `order` symbols up to it, `bits` bits each, the newest lowest.

    symbols starts with order - 1 edges, which get no position of their own.
    """
    kind = np.uint32 if order * bits <= 32 else np.int64
    if len(symbols) < order:
        return np.empty(0, kind)
    codes, width = symbols, 1
    # Codes of twice the width from two of half of it, in the narrowest type that holds them.
    for digit in f"{order:b}"[1:]:
        for more in (width, 1)[: 1 + int(digit)]:
            wide = np.uint16 if (width + more) * bits <= 16 else np.uint32 if (width + more) * bits <= 32 else np.int64
            tail = codes[width:] if more == width else symbols[width:]
            codes = (codes[: len(codes) - more].astype(wide) << wide(more * bits)) | tail.astype(wide)
            width += more
    return codes.astype(kind)
