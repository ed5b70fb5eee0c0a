"""Token ids from the public tokenizer files, memoised per pre-token.

The ``tokenizers`` library takes some ten microseconds a word. Texts repeat most
of their words, so a worker keeps the ids of each pre-token it has met. Texts
are cut into pre-tokens here by the very pattern that the tokenizer file names,
for texts whose characters all lie in Latin-1, where that pattern can be spelt
out exactly; any other text, and any text that holds a special token's string,
is given to the library whole. The ids are those of
``encode(text, add_special_tokens=False)`` in every case.
"""

from __future__ import annotations

import os
import re

import numpy as np

from skein.llm.common import Memo

_SPACE = r"\t-\r \x85\xa0"
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_NUMBER = "0-9²³¹¼½¾"
_SPLITS = {
    "byte": re.compile(
        rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+"
        rf"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
    ),
    "word": re.compile(
        rf"'(?:[stmd]|re|ve|ll)|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+"
    ),
}
_WIDER = re.compile("[^\x00-\xff]")


def _byte_letters() -> str:
    """The character that stands for each byte in a byte-level model: printable ones for themselves,
    the others for what follows Latin-1, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    more = iter(range(256, 512))
    return "".join(chr(b if b in shown else next(more)) for b in range(256))


class Ids:
    """text -> little-endian ids. ``kind``: "byte" keeps the text as it is, "word" lower-cases it."""

    def __init__(self, path: str, kind: str, dtype: str, limit: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._one = Tokenizer.from_file(path)
        self._special = tuple(t.content for t in self._one.get_added_tokens_decoder().values())
        self._cut = _SPLITS[kind].findall
        self._lower = kind == "word"
        self._dtype = dtype
        self._memo = Memo(self._piece, limit)
        self._model, self._letters = self._one.model, _byte_letters()
        self._known = self._same_cut()

    def _same_cut(self) -> bool:
        """Whether the file cuts and normalises like the pattern: else the library takes whole texts."""
        probe = "It's A  b1234 ÄÖ--x\t\n y's we'll 12.5 ﬁ…!? \u00a0z  ".replace("ﬁ", "fi").replace("…", "...")
        whole = self._encode(probe)
        return whole == b"".join(map(self._piece, self._cut(probe.lower() if self._lower else probe)))

    def _piece(self, piece: str) -> bytes:
        """The ids of one pre-token, from the file's model without the steps before it."""
        letters = piece.encode().decode("latin-1").translate(self._letters)
        return np.array([t.id for t in self._model.tokenize(letters)], self._dtype).tobytes()

    def _encode(self, text: str) -> bytes:
        return np.array(self._one.encode(text, add_special_tokens=False).ids, self._dtype).tobytes()

    def __call__(self, text: str) -> bytes:
        if not self._known or _WIDER.search(text) or any(s in text.lower() for s in self._special):
            return self._encode(text)
        return b"".join(map(self._memo.__getitem__, self._cut(text.lower() if self._lower else text)))
