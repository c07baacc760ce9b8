"""Pre-tokens of the tokenizer in word_bpe_49k.json, and its ids through them.

The tokenizer lower-cases, drops white space, cuts a text into pre-tokens and splits each of these by itself.
Texts within Latin-1, which NFC leaves as they are, are cut by a regular expression; others by the library's own
normalizer and pre-tokenizer. A text that holds a special string goes to the library as a whole.
"""

from __future__ import annotations

import re
import struct
from collections import defaultdict
from itertools import count

import numpy as np

#: Fixed values of the public byte-level alphabet: these bytes stand for themselves, the rest follow from U+0100.
OWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
ALPHABET = {**{b: chr(b) for b in OWN}, **{b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in OWN)}}
#: The tokenizer's split, for lower-case text within Latin-1.
LATIN = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]"
    "|[^\t-\r \x85\xa0a-z0-9\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-\xff]+"
)
GAP = re.compile("[\t-\r ]")
#: The same for words that are joined by line feeds, which stay.
LATIN_LINES = re.compile(f"{LATIN.pattern}|\n")
#: Characters at which str.split() cuts and the tokenizer doesn't.
NO_GAP = re.compile("[\x1c-\x1f]")
PIECE, LONG = 1 << 20, 256
#: Bytes that a table of what is known may hold, about, and those of an entry besides its key and value.
KNOWN, ENTRY = 1 << 25, 160
#: Words that are held until the ids of the distinct ones are looked up together.
HELD = 1 << 21


class Known(dict):
    """What `of(key)` gives, worked out once for each distinct key. Of two generations the older goes when the
    newer is full: memory is bounded, in bytes, frequent keys stay, and only repeated work follows from a lost one."""

    def __init__(self, of):
        super().__init__()
        self.of, self.older, self.size = of, {}, 0

    def __missing__(self, key):
        out = self.older.get(key)
        if out is None:
            out = self.of(key)
        if len(key) < LONG:
            self.size += ENTRY + len(key) + (len(out) if isinstance(out, bytes) else 0)
            if self.size > KNOWN // 2:
                self.older = dict(self)
                self.clear()
                self.size = 0
            self[key] = out
        return out


class PreTokens:
    """One for each Python worker and tokenizer (see at())."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        #: By pre-token its ids, as little-endian unsigned 32-bit integers.
        self.ids = Known(self._ids)

    @staticmethod
    def at(path: str) -> PreTokens:
        if path not in LOADED:
            LOADED[path] = PreTokens(path)
        return LOADED[path]

    def _split(self, token: str):
        return self.tokenizer.model.tokenize("".join(map(ALPHABET.__getitem__, token.encode())))

    def _ids(self, token: str) -> bytes:
        found = [x.id for x in self._split(token)]
        return struct.pack(f"<{len(found)}I", *found)

    def has_special(self, text: str) -> bool:
        return any(x in text for x in self.special)

    def whole(self, text: str) -> list[int] | None:
        """The ids of a text that holds a special string."""
        if self.has_special(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return None

    def cut(self, text: str):
        """Lists for a text without special strings, long ones in several: (True, words) or (False, pre-tokens)."""
        lo, n = 0, len(text)
        while lo < n:
            hi = n
            if n - lo > PIECE:
                gap = GAP.search(text, lo + PIECE)
                hi = gap.start() if gap else n
            part = text if hi - lo == n else text[lo:hi]
            try:
                part.encode("latin-1")
            except UnicodeEncodeError:
                low = self.tokenizer.normalizer.normalize_str(part)
                yield False, [low[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(low)]
            else:
                low = part.lower()
                yield (False, LATIN.findall(low)) if NO_GAP.search(low) else (True, low.split())
            lo = hi

    def n_pieces(self, token: str) -> int:
        return len(self._split(token))

    def id_bytes(self, texts):
        """For each text its ids as little-endian unsigned 32-bit integers. Words and pre-tokens are numbered as they
        come, and HELD of them at a time (or a long text's part) are looked up, each distinct one once."""
        words, tokens = (defaultdict(count().__next__) for _ in range(2))
        held, n = [], 0  # by text its parts: bytes, or (whether words, their numbers)

        def looked_up():
            of_words, of_tokens = self._word_ids(list(words)), self._token_ids(list(tokens))
            for parts in held:
                yield b"".join(
                    p if isinstance(p, bytes) else gathered(*(of_words if p[0] else of_tokens), p[1])[0].tobytes() for p in parts
                )
            for x in (words, tokens):
                x.clear()
                x.default_factory = count().__next__
            held.clear()

        for text in texts:
            if not text:
                held.append([])
            elif (ids := self.whole(text)) is not None:
                held.append([struct.pack(f"<{len(ids)}I", *ids)])
            else:
                held.append([])
                for of_words, part in self.cut(text):
                    index = words if of_words else tokens
                    held[-1].append((of_words, np.fromiter(map(index.__getitem__, part), np.int32, len(part))))
                    n += len(part)
            if n >= HELD:
                yield from looked_up()
                n = 0
        yield from looked_up()

    def _token_ids(self, tokens: list[str]):
        """Ids of pre-tokens, one after another, and the n + 1 offsets."""
        found = list(map(self.ids.__getitem__, tokens))
        return np.frombuffer(b"".join(found), "<u4"), offsets_of(np.fromiter(map(len, found), np.int64, len(found)) // 4)

    def _word_ids(self, words: list[str]):
        """Ids of words between white space, one after another, and the n + 1 offsets."""
        tokens = defaultdict(count(1).__next__, {"\n": 0})
        cut = LATIN_LINES.findall("\n".join([*words, ""]))
        cut = np.fromiter(map(tokens.__getitem__, cut), np.int32, len(cut))
        ends = np.flatnonzero(cut == 0)
        flat, at = self._token_ids(list(tokens)[1:])
        ids, lengths = gathered(flat, at, cut[cut > 0] - 1)
        whole = offsets_of(lengths)
        return ids, np.concatenate([[0], whole[ends - np.arange(len(ends))]])


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])


def gathered(flat: np.ndarray, offsets: np.ndarray, which: np.ndarray):
    """The ranges of `flat` with these numbers, one after another, and their lengths."""
    start = offsets[which]
    lengths = offsets[which + 1] - start
    place = np.repeat(start - offsets_of(lengths)[:-1], lengths)
    place += np.arange(len(place))
    return flat[place], lengths


#: Python workers serve many tasks; what is known stays with them.
LOADED: dict[str, PreTokens] = {}


def forget() -> None:
    """Frees these tables: workers that turn to another operator need the room."""
    LOADED.clear()
